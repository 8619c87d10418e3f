"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the embeddings that its hashes name: two of the word and one each of its first three,
four and five letters, so that a chance collision moves a fifth of a vector. Filters of one, two and three words run
over the text; each gives its maximum, and a logistic layer weighs the maxima. Scores are calibrated so that 0.5 is the
threshold that suits the text's language; the language is told from the words' hashes, never from a column.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import bounded_sample, chunks, pieces, remainder
from veriframe.llm.langid import _letters

BUCKETS = 1 << 18
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
#: Labelled texts learnt from for each language and label, about; of how many languages and labels, the most frequent; of
#: all together; their bytes. The only bounded part.
SAMPLE, KINDS, TOTAL, BYTES = 400, 24, 6000, 24_000_000
EPOCHS = 4
#: A language has a threshold of its own if so many toxic texts are there to set it.
ENOUGH = 15
_PREFIXES = (3, 4, 5)
_PAD = max(WIDTHS) - 1
#: Characters of a longer text that are scored at once.
PIECE = 400_000


@functools.cache
def _powers() -> np.ndarray:
    return np.array([pow(2654435761, i, 1 << 32) for i in range(1024)], np.uint32)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, 5) places of each word's embeddings, and the number of words of each text.

    A word is a run of letters, lowered.
    """
    joined = " ".join(texts) + " "
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = code != 0
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(first):
        return np.zeros((0, 5), np.int32), np.zeros(len(texts), np.int64)
    lengths = np.array([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(first, np.concatenate(([0], np.cumsum(lengths)))))
    at = np.flatnonzero(inside)
    letters = code[at]
    begin = np.searchsorted(at, first)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    term = letters * _powers()[np.minimum(place, 1023)]
    mixed = [np.add.reduceat(term, begin, dtype=np.uint32)]
    mixed += [np.add.reduceat(np.where(place < k, term, np.uint32(0)), begin, dtype=np.uint32) + np.uint32(k * 40503) for k in _PREFIXES]
    mixed.insert(1, mixed[0] ^ np.uint32(0x5BD1E995))
    out = np.empty((len(first), 5), np.int32)
    for i, h in enumerate(mixed):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917)
        out[:, i] = (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    return out, counts


class Model:
    """Embeddings, filters, the logistic layer, thresholds by language."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.01, (BUCKETS, DIMS)).astype(np.float32)
        self.filters = [r.normal(0, 0.05, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # one filter of each width begins by reading the first coordinate
            f[0, 0, 0] = 1.0
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.weights = np.concatenate([np.r_[1.5, r.normal(0, 0.05, FILTERS - 1)] for _ in WIDTHS]).astype(np.float32)
        self.shift = np.float32(-2.0)
        self.langs: list[str] = []
        self.by_word = np.zeros((0, 0), np.float32)
        self.prior = np.zeros(0)
        self.cut: dict[str | None, tuple[float, float]] = {None: (1.0, 0.0)}

    def _layout(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with zeros between texts, where each text begins, and which rows are words."""
        starts = np.cumsum(counts + _PAD) - (counts + _PAD)
        x = np.zeros((int((counts + _PAD).sum()) + _PAD, DIMS), np.float32)
        row = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * _PAD, counts)
        x[row] = self._vectors(hashes)
        inside = np.zeros(len(x) - _PAD, bool)
        inside[row] = True
        return x, starts, inside

    def _maxima(self, x: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over the windows that begin at a text's words, 0 at least, and the filters' maps."""
        maps, n = [], len(x) - _PAD
        for f, b in zip(self.filters, np.split(self.bias, len(WIDTHS))):
            y = sum(x[k : k + n] @ f[k] for k in range(len(f))) + b
            maps.append(np.maximum(y, 0) * inside[:, None])
        return np.concatenate([np.maximum.reduceat(y, starts) for y in maps], axis=1), maps

    def raw(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """The logistic layer's sums and the languages told from the words."""
        if len(texts) > 1 and max(map(len, texts)) > PIECE:
            found = [self.raw([t]) for t in texts]
            return np.concatenate([z for z, _ in found]), [v for _, langs in found for v in langs]
        top = np.zeros((len(texts), len(self.bias)), np.float32)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(texts) == 1:
            # words of a long text in parts that overlap by a filter's width, so that no window is missed
            tail = np.zeros((0, 5), np.int32)
            parts = list(pieces(texts[0], PIECE))
            for i, part in enumerate(parts):
                own = word_hashes([part])[0]
                sums[0] += self._told(own)
                hashes = np.concatenate([tail, own])
                x = self._vectors(hashes)
                if i == len(parts) - 1:
                    x = np.concatenate([x, np.zeros((_PAD, DIMS), np.float32)])
                if len(x) > _PAD:
                    np.maximum(top, self._maxima(x, np.zeros(1, np.int64), np.ones(len(x) - _PAD, bool))[0], out=top)
                tail = hashes[len(hashes) - min(len(hashes), _PAD) :]
        else:
            hashes, counts = word_hashes(texts)
            top = self._maxima(*self._layout(hashes, counts))[0]
            first = np.cumsum(counts) - counts
            for k in np.flatnonzero(counts):
                sums[k] = self._told(hashes[first[k] : first[k] + counts[k]])
        z = top @ self.weights + self.shift
        return z, [self.langs[k] for k in (sums + self.prior).argmax(1)] if self.langs else [None] * len(texts)

    def _told(self, hashes: np.ndarray) -> np.ndarray:
        """How much some words speak for each language."""
        return self.by_word[hashes[:, 0]].sum(0, dtype=np.float64) if self.langs else np.zeros(0)

    def _vectors(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), DIMS), np.float32)
        for k in range(hashes.shape[1]):
            out += self.table[hashes[:, k]]
        return out / np.float32(hashes.shape[1])

    def score(self, texts: list[str]) -> np.ndarray:
        z, langs = self.raw(texts)
        slope, cut = np.array([self.cut.get(v, self.cut[None]) for v in langs]).T
        return 1 / (1 + np.exp(-np.clip(slope * (z - cut), -40, 40)))

    def train(self, texts: list[str], toxic: np.ndarray, langs: list[str], weight: np.ndarray) -> None:
        """Fits on three quarters of the texts (by order) and sets the thresholds on all of them."""
        self.langs = sorted({v for v in langs if v is not None})
        if not len(texts):
            return
        # in pieces, for hashing takes many times a text's own memory
        parts = [word_hashes(texts[i : i + 64]) for i in range(0, len(texts), 64)]
        hashes, counts = (np.concatenate(x) for x in zip(*parts))
        del parts
        first = np.cumsum(counts) - counts
        lang_of = np.array([self.langs.index(v) if v is not None else -1 for v in langs])
        if self.langs:
            word_lang = np.repeat(lang_of, counts)
            seen = np.stack([np.bincount(hashes[word_lang == k, 0], minlength=BUCKETS) for k in range(len(self.langs))], axis=1).astype(np.float32) + 0.05
            self.by_word = np.log(seen / seen.sum(0)).astype(np.float32)
            self.prior = np.log((np.bincount(lang_of[lang_of >= 0], minlength=len(self.langs)) + 1) / len(texts))
        fitted = np.arange(len(texts)) % 4 != 3
        self._begin(hashes, counts, toxic, fitted)
        r, order = np.random.default_rng(5), np.flatnonzero(fitted)
        memory: dict[str, np.ndarray] = {}
        for _ in range(EPOCHS):
            order = order[np.argsort(r.random(len(order)), kind="stable")]
            for i in range(0, len(order), 64):
                docs = order[i : i + 64]
                rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs]).astype(np.int64)
                self._step(hashes[rows], counts[docs], toxic[docs], memory)
        self._thresholds(texts, toxic, weight, ~fitted)

    def _begin(self, hashes: np.ndarray, counts: np.ndarray, toxic: np.ndarray, fitted: np.ndarray) -> None:
        """The first coordinate begins as the log odds of the texts that name a place, shrunk where these are few."""
        doc = np.repeat(np.arange(len(counts)), counts)
        use = fitted[doc]
        both = np.zeros((2, BUCKETS))
        for k in range(hashes.shape[1]):
            pairs = np.unique(doc[use] * BUCKETS + hashes[use, k])
            np.add.at(both, (toxic[pairs // BUCKETS].astype(int), pairs % BUCKETS), 1.0)
        n = np.maximum(np.bincount(toxic[fitted].astype(int), minlength=2), 1)
        good, bad = both
        odds = np.log((bad + 0.1) / (n[1] + 0.2)) - np.log((good + 0.1) / (n[0] + 0.2))
        sure = np.clip((bad + good - 1) / 4, 0, 1)
        self.table[:, 0] += np.clip(odds * sure, -4, 4).astype(np.float32)

    def _step(self, hashes: np.ndarray, counts: np.ndarray, toxic: np.ndarray, memory: dict[str, np.ndarray], rate: float = 0.02) -> None:
        x, starts, inside = self._layout(hashes, counts)
        top, maps = self._maxima(x, starts, inside)
        p = 1 / (1 + np.exp(-np.clip(top @ self.weights + self.shift, -30, 30)))
        g = ((p - toxic) / len(toxic)).astype(np.float32)
        length = counts + _PAD
        doc = np.repeat(np.arange(len(counts)), length)
        grad_x = np.zeros_like(x)
        grad_f = [np.zeros_like(f) for f in self.filters]
        grad_b = np.zeros_like(self.bias)
        for c in range(len(self.bias)):
            k, j = divmod(c, FILTERS)
            y = maps[k][:, j]
            hit = np.flatnonzero((y == top[doc, c]) & (y > 0))
            if not len(hit):
                continue
            d, one = np.unique(doc[hit], return_index=True)
            at, back = hit[one], g[d] * self.weights[c]
            grad_b[c] = back.sum()
            for w in range(WIDTHS[k]):
                grad_f[k][w, :, j] = back @ x[at + w]
                np.add.at(grad_x, at + w, back[:, None] * self.filters[k][w, :, j])
        step = lambda name, value, grad: self._adagrad(memory, name, value, grad, rate)
        step("weights", self.weights, top.T @ g)
        shift = np.array([self.shift], np.float32)
        step("shift", shift, np.array([g.sum()], np.float32))
        self.shift = shift[0]
        step("bias", self.bias, grad_b)
        for k, f in enumerate(self.filters):
            step(f"filter{k}", f, grad_f[k])
        row = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)) * _PAD, counts)
        moved = np.flatnonzero(grad_x[row].any(1))
        if len(moved):
            places = hashes[moved].ravel()
            grads = np.repeat(grad_x[row[moved]] / hashes.shape[1], hashes.shape[1], axis=0)
            u, inverse = np.unique(places, return_inverse=True)
            total = np.zeros((len(u), DIMS), np.float32)
            np.add.at(total, inverse, grads)
            memory.setdefault("table", np.full(self.table.shape, 1e-6, np.float32))
            memory["table"][u] += total * total
            self.table[u] -= rate * total / np.sqrt(memory["table"][u])

    @staticmethod
    def _adagrad(memory: dict[str, np.ndarray], name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m = memory.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        m += grad * grad
        value -= rate * grad / np.sqrt(m)

    def _thresholds(self, texts: list[str], toxic: np.ndarray, weight: np.ndarray, apart: np.ndarray) -> None:
        """Where weighted errors on the texts set apart are fewest; the middle of the widest such gap."""
        z, langs = [], []
        for i in range(0, len(texts), 128):
            a, b = self.raw(texts[i : i + 128])
            z.append(a)
            langs += b
        z, langs = np.concatenate(z), np.array(langs, object)

        def best(use: np.ndarray) -> tuple[float, float] | None:
            bad = int(toxic[use].sum())
            if bad < ENOUGH or bad == use.sum():
                return None
            order = np.argsort(z[use], kind="stable")
            s, y, w = z[use][order], toxic[use][order], weight[use][order]
            # cut before position i: toxic ones below and clean ones above are errors
            errors = np.concatenate(([0], np.cumsum(w * y))) + (w * (1 - y)).sum() - np.concatenate(([0], np.cumsum(w * (1 - y))))
            edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
            gaps = edges[1:] - edges[:-1]
            at = np.flatnonzero(errors <= errors.min() + 1e-9)
            i = at[gaps[at].argmax()]
            return 1.0, float((edges[i] + edges[i + 1]) / 2)

        # a label that is always there, or never, gives no threshold: the layer's own 0
        self.cut = {None: best(apart) or best(np.ones(len(z), bool)) or (1.0, 0.0 if toxic.any() else float(z.max(initial=0.0)) + 1)}
        for v in self.langs:
            if found := best(apart & (langs == v)):
                self.cut[v] = found


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", modulus: int = 5, sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` labelled texts of each language and label whose crc32 of the key has a remainder other than 0.

    A key labelled more than once has its largest label; null labels and keys are left out. The languages of the texts
    learnt from only teach the model to tell languages by words. Of a key that repeats one text is learnt from. Bounds:
    KINDS languages and labels, TOTAL texts and BYTES bytes; see :func:`bounded_sample`.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key, modulus) != 0)).groupBy(F.col(key).cast("bigint").alias("_k")).agg(F.max(F.when(F.col(label) != 0, 1).otherwise(0)).alias("_y"))
    listed = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(lang).alias("_lang"))
    have = listed.join(known, F.col("_id") == F.col("_k")).select("_id", "_lang", "_y")
    found = bounded_sample(have, docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), ["_lang", "_y"], "_id", "_text", sample, KINDS, TOTAL, BYTES)
    # an order that has nothing to do with the strata
    texts, langs, toxic = [r.text for r in found], [r.stratum[0] for r in found], np.array([r.stratum[1] for r in found], np.float32)
    drawn = Counter(r.stratum for r in found)
    weight = np.array([r.rows / drawn[r.stratum] for r in found])
    model = Model()
    model.train(texts, toxic, langs, weight)
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row: whole texts, null as the empty text; predicted is 1 from a score of 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b, text, 400_000):
                s = shared.value.score(part).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, f"{key} bigint, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) of every row; learnt from rows that aren't held out."""
    held = F.coalesce(remainder(key, modulus) == 0, F.lit(False))
    return scored(docs, fit(docs, labels, key, text, modulus=modulus), key, text).withColumn("held_out", held)


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; decided row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b, b.schema.names[place], 400_000):
                yield b.slice(start, len(part)).filter(pa.array(shared.value.score(part) < 0.5))

    return docs.mapInArrow(run, docs.schema)
