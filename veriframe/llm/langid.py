"""Language identification by nearest centroids of character n-grams.

A text's letters are lowered, everything else is one gap; its 2- and 3-grams, hashed to DIMS places, give a vector of
log(1 + count) times the inverse document frequency, of length one. Each language has several centroids, the clusters of
a bounded sample of its labelled texts. A text has the language of the centroid with the largest cosine, and is
rejected where its distance is larger than that of nearly all of the language's sample.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import bounded_sample, chunks, pieces, remainder

DIMS = 1 << 13
CENTROIDS = 3
#: Texts a language is learnt from, about; how many languages, the most frequent; texts of all together; their bytes. The
#: only bounded part.
SAMPLE, KINDS, TOTAL, BYTES = 400, 500, 4000, 32_000_000
#: Share of a language's own sample that is farther than its rejection distance.
FAR = 0.002
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + count) of each text's hashed n-grams, and whether it has a letter.

    Long texts are counted in pieces between letters, which have the same n-grams together.
    """
    out, letters = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    held: list[tuple[int, str]] = []

    def count() -> None:
        c, some = _counts([x for _, x in held])
        owners = np.array([i for i, _ in held])
        np.add.at(out, owners, c)
        np.logical_or.at(letters, owners, some)
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for x in pieces(t):
            if held and size + len(x) > 300_000:
                count()
                size = 0
            held.append((i, x))
            size += len(x)
    if held:
        count()
    return np.log1p(out, out), letters


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = " " + "  ".join(texts) + " "
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    assert len(code) == ends[-1]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    one, two = code[:-1] * np.uint32(2654435761), code[1:] * np.uint32(2246822519)
    pair = (one ^ (two >> np.uint32(7)) ^ two) * np.uint32(3266489917)
    third = np.append(code[2:], np.uint32(0)) * np.uint32(668265263)
    triple = (pair ^ (third >> np.uint32(9)) ^ third) * np.uint32(374761393)
    inside = doc[1:] == doc[:-1]
    whole = inside & np.append(doc[2:] == doc[:-2], False) & (code[1:] != 0)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    place = np.concatenate(((pair >> shift)[inside], (triple >> shift)[whole]))
    owner = np.concatenate((doc[:-1][inside], doc[:-1][whole]))
    out = np.bincount(owner * DIMS + place, minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float32)
    letters = np.bincount(doc[code != 0], minlength=len(texts)) > 0
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Model:
    def __init__(self, texts: list[str], langs: list[str], centroids: int = CENTROIDS) -> None:
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        x = np.concatenate([vectors(texts[i : i + 64])[0] for i in range(0, len(texts), 64)])
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = _unit(x * self.idf)
        own = np.array([self.langs.index(v) for v in langs])
        self.centre, self.of, self.far = [], [], []
        for k in range(len(self.langs)):
            mine = x[own == k]
            c = self._clusters(mine, centroids)
            self.centre.append(c)
            self.of += [k] * len(c)
            self.far.append(float(np.quantile((mine @ c.T).max(1), FAR)))
        self.centre, self.of, self.far = np.concatenate(self.centre), np.array(self.of), np.array(self.far)

    @staticmethod
    def _clusters(x: np.ndarray, k: int) -> np.ndarray:
        """Spherical k-means; begins with the mean's nearest row, then the row farthest from those chosen."""
        chosen = [int((x @ x.mean(0)).argmax())]
        while len(chosen) < min(k, len(x)):
            chosen.append(int((x @ x[chosen].T).max(1).argmin()))
        c = x[chosen]
        for _ in range(12):
            near = (x @ c.T).argmax(1)
            c = _unit(np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
        return c

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines (0 to 1) and whether the distance rejects them."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, letters = vectors(texts)
        cos = _unit(x * self.idf) @ self.centre.T
        best = self.of[cos.argmax(1)]
        near = cos.max(1)
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return lang, np.where(letters, np.clip(near, 0, 1), 0).astype(np.float64), ~letters | (near < self.far[best])


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` rows of each language, chosen by hash; null languages and keys are left out.

    Of a key that repeats one text is learnt from. Bounds: KINDS languages, TOTAL texts and BYTES bytes; see
    :func:`bounded_sample`. With many languages each has fewer texts, eight at least.
    """
    have = train.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    found = bounded_sample(have.select(F.col(key).alias("k"), F.col(lang).alias("l")), have.select(F.col(key).alias("k"), F.col(text).alias("t")), ["l"], "k", "t", sample, KINDS, TOTAL, BYTES)
    return Model([r.text for r in found], [r.stratum[0] for r in found])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row; whole texts.

    A null text or one without a letter is ``und`` with score 0, as is every text where nothing could be learnt. score
    is the cosine with the nearest centroid; rejected says that the distance is beyond the language's own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b, text, 300_000):
                for i in range(0, len(part), 256):
                    lang, score, far = shared.value.predict(part[i : i + 256])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start + i, len(lang)).cast(pa.int64()), pa.array(lang), pa.array(score), pa.array(far)], names=[key, "lang_pred", "score", "rejected"])

    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, f"{key} bigint, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 5) -> DataFrame:
    """Learns from rows whose crc32 of the key as text has another remainder than 0, predicts all rows; adds held_out.

    A null key is learnt from by nothing and not held out.
    """
    held = F.coalesce(remainder(key, modulus) == 0, F.lit(False))
    model = fit(docs.where(~held), key, text, lang)
    return predict(docs, model, key, text).withColumn("held_out", held)
