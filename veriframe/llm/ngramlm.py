"""Language-model scores by a weighted backoff automaton.

Every n-gram of up to ORDER tokens that occurs in a training text is kept, whatever its count and the corpus's size. The
n-grams that tokens follow are the automaton's states. An arc of a state leads by a word that was seen after it, with
the smoothed probability (c(hw) + M * P(w | shorter)) / (c(h) + M); the failure arc leads to the next shorter context
with the weight M / (c(h) + M), so each state's probabilities add up to one. The root has an arc for each word, with the
probability (c + 1) / (N + V + 1), and one, with count 0, for a word that was never seen.

The automaton is never in one place. Texts are dealt into blocks of bounded size. A block names its distinct n-grams by
sorted hashes, in one piece for each range of hashes; a range adds up what all blocks count in it and answers each piece
with the totals, in the piece's order. The block's texts then meet the part of the automaton that they can traverse. What
is exchanged grows with the distinct n-grams of the blocks, whatever is frequent in them, and no key is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import remainder, written

ORDER = 3
#: M of each order from the second on: what the shorter context counts for.
STRENGTH = (1000.0, 10.0)
#: Bytes of text of a block, or one longer text.
BLOCK = 16_000_000
#: Hashes that a range adds up, about.
RANGE = 6_000_000
#: Bits of a hash beyond those that number the corpus's bytes: one n-gram in a million shares its hash with another.
SPARE = 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text, counted as a token; no word is empty.
END = b""
#: The context that a text begins with.
_START = np.uint64(0x9E3779B97F4A7C15)
_ZSTD = pa.Codec("zstd", compression_level=1)


def tokens(text: str) -> list[bytes]:
    """Runs of other than ASCII white space with A-Z lowered, then one end."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words.append(END)
    return words


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what ``a`` and ``b`` are hashes of, in this order."""
    x = a * np.uint64(0xFF51AFD7ED558CCD) + b * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends at each token, and the number of tokens of each text.

    The first n-gram of a text begins with the start; a token without so long an n-gram has the hash 0.
    """
    of = _Hashes().__getitem__
    parts = [np.fromiter(map(of, tokens(t)), np.uint64) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(counts) - counts
    out = [np.concatenate(parts) if parts else np.zeros(0, np.uint64)]
    word = out[0]
    context = np.empty_like(word)  # hash of the n - 1 tokens before each token
    for n in range(2, order + 1):
        context[1:] = out[-1][:-1]
        context[first] = _START if n == 2 else 0
        gram = _joined(context, word)
        for k in range(n - 2):  # tokens too near the beginning
            gram[(first + k)[counts > k]] = 0
        out.append(gram)
    return out, counts


def _pack(a: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight together, compressed."""
    body = _ZSTD.compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)
    return struct.pack("<II", len(a), len(body)) + body


def _unpack(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, size = struct.unpack_from("<II", data, at)
    at += 8
    raw = _ZSTD.decompress(data[at : at + size], 8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel(), at + size


def _keys(hashes: np.ndarray, number: int, bits: int) -> np.ndarray:
    """What stands for n-grams in exchanges: words by their whole hash, others by its leading bits."""
    return hashes if number == 0 else hashes >> np.uint64(64 - bits)


def _ranges(keys: np.ndarray, number: int, bits: int, ranges: int) -> np.ndarray:
    """Where each range begins in sorted keys, and the end."""
    top = keys >> np.uint64((64 if number == 0 else bits) - 31)
    return np.searchsorted(top, np.array([-(-(r << 31) // ranges) for r in range(ranges + 1)], np.uint64))


def blocks(docs: DataFrame, key: str, text: str, held: F.Column) -> DataFrame:
    """(k, t, held, size, block) of every row: texts in blocks of BLOCK bytes or one longer text, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, full = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            at = []
            for size in b.column(3).to_pylist():
                if full and full + size > BLOCK:
                    number, full = number + 1, 0
                full += size
                at.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["k", "t", "held", "size", "block"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), held.alias("held"))
    rows = rows.withColumn("size", F.octet_length("t").cast("bigint") + 1)
    return written(rows.mapInArrow(run, "k bigint, t string, held boolean, size bigint, block bigint"), "lm-texts", compression="zstd")


def counted(texts: DataFrame, order: int, ranges: int, bits: int) -> DataFrame:
    """(block, part, n, v, data): for each block and range of hashes, the training counts of the block's n-grams.

    Packed by order, in the order of the hashes. n and v: training tokens and distinct words of a range, in rows of
    their own (block null).
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool]] = []
        block = None

        def out() -> Iterator[pa.RecordBatch]:
            found, lengths = grams([t for t, _ in held], order)
            learnt = np.repeat(np.array([not h for _, h in held]), lengths)
            parts: list[list[bytes]] = [[] for _ in range(ranges)]
            while found:
                number, h = order - len(found), found.pop(0)
                use = h != 0 if number > 1 else slice(None)
                keys, at = np.unique(_keys(h[use], number, bits), return_inverse=True)
                n = np.bincount(at[learnt[use]], minlength=len(keys)).astype(np.uint64)
                bounds = _ranges(keys, number, bits, ranges).tolist()
                for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    parts[p] += [_pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(n[a:b])]
            for i in range(0, ranges, 64):
                some = range(i, min(i + 64, ranges))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([b"".join(parts[p]) for p in some], pa.binary())], names=["block", "part", "data"])

        for b in batches:
            for i in range(b.num_rows):
                now = b.column(2)[i].as_py()
                if now != block:
                    if held:
                        yield from out()
                    held, block = [], now
                held.append((b.column(0)[i].as_py(), b.column(1)[i].as_py()))
        if held:
            yield from out()

    def added(rows: pa.Table) -> pa.Table:
        part, pieces_of = rows.column("part")[0].as_py(), {}
        for b, d in zip(rows.column("block").to_pylist(), rows.column("data").to_pylist()):
            pieces_of.setdefault(b, []).append(d)
        names = sorted(pieces_of)
        at = {b: [0] * len(pieces_of[b]) for b in names}
        answers: dict[int, list[bytes]] = {b: [] for b in names}
        n = v = 0
        for number in range(order):
            keys, counts, ends = [], [], []
            for b in names:
                own, own_counts = [], []
                for i, d in enumerate(pieces_of[b]):
                    k, at[b][i] = _unpack(d, at[b][i])
                    c, at[b][i] = _unpack(d, at[b][i])
                    own.append(np.cumsum(k, dtype=np.uint64))
                    own_counts.append(c)
                if len(own) > 1:  # a block that more than one task has read
                    k, inverse = np.unique(np.concatenate(own), return_inverse=True)
                    own, own_counts = [k], [np.bincount(inverse, np.concatenate(own_counts), len(k)).astype(np.uint64)]
                keys += own
                counts += own_counts
                ends.append(len(own[0]))
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(every)).astype(np.uint64)
            if number == 0:
                n, v = int(total.sum()), int((total > 0).sum())
            for b, own in zip(names, np.split(inverse, np.cumsum(ends)[:-1])):
                answers[b].append(_pack(total[own]))
        return pa.table({"block": pa.array([*names, None], pa.int64()), "part": pa.array([part] * (len(names) + 1), pa.int32()), "n": pa.array([None] * len(names) + [n], pa.int64()), "v": pa.array([None] * len(names) + [v], pa.int64()), "data": pa.array([*(b"".join(answers[b]) for b in names), None], pa.binary())})

    named = texts.select("t", "held", "block").mapInArrow(pieces, "block bigint, part int, data binary")
    return named.repartition(ranges, "part").groupBy("part").applyInArrow(added, "block bigint, part int, n bigint, v bigint, data binary")


class Automaton:
    """The part of the automaton that some tokens traverse: for each token, the counts of the n-grams that end there.

    counts: by order; a token's contexts are the n-grams that end at the token before it.
    """

    def __init__(self, counts: list[np.ndarray], first: np.ndarray, texts: int, total: int, words: int, strength: tuple[float, ...] = STRENGTH) -> None:
        self.counts, self.first, self.texts, self.strength = counts, first, texts, strength
        self.root = (counts[0] + 1) / (total + words + 1)

    def weights(self) -> np.ndarray:
        """log10 of what the arcs and failure arcs on each token's way multiply to, from left to right.

        A token's state is the longest of its contexts that was seen. Where that has no arc by the token, the failure
        arc's weight is taken and the next shorter context is asked, at last the root.
        """
        p = self.root
        for number, m in enumerate(self.strength[: len(self.counts) - 1], 1):
            state = np.empty_like(p)
            state[1:] = self.counts[number - 1][:-1]
            state[self.first] = self.texts if number == 1 else 0  # no longer context than the start
            failure = m / (state + m)
            p = np.where(self.counts[number] > 0, (self.counts[number] + m * p) / (state + m), failure * p)
        return np.log10(p)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER, strength: tuple[float, ...] = STRENGTH) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the key as text has the remainder ``held`` are not learnt from; null keys are learnt from. A
    null or empty text is one token, the end. score: log10 of the probability of the text, the sum over its tokens of
    the automaton's weights. A word that was never seen has the root's probability for count 0, so texts of such words
    score low. Without any training text every score is 0. Rows that repeat key and text have equal results. One text
    is never split: a worker needs about 150 bytes of memory for each of its tokens.
    """
    texts = blocks(docs, key, text, F.coalesce(remainder(key, modulus) == held, F.lit(False)))
    size = texts.agg(F.sum("size")).first()[0] or 0
    # a token takes two bytes or more; no block has more n-grams than tokens of each order
    ranges, bits = max(1, -(-size * order // (6 * RANGE))), min(64, size.bit_length() + SPARE)
    counts = written(counted(texts, order, ranges, bits), "lm-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found, lengths = grams(left.column("t").to_pylist(), order)
        answers = right.sort_by("part").column("data").to_pylist()
        at, first = [0] * len(answers), np.cumsum(lengths) - lengths
        by_order, texts_learnt = [], 0
        for number in range(order):
            h = found[number]
            found[number] = None
            use = h != 0 if number > 1 else np.ones(len(h), bool)
            got = []
            for i, d in enumerate(answers):
                c, at[i] = _unpack(d, at[i])
                got.append(c)
            inverse = np.unique(_keys(h[use], number, bits), return_inverse=True)[1]
            c = np.zeros(len(h))
            c[use] = np.concatenate(got)[inverse]
            if number == 0:
                texts_learnt = c[lengths[0] - 1]  # each text has one end
            by_order.append(c)
        model = Automaton(by_order, first, texts_learnt, n, v, strength)
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({"k": left.column("k"), "held": left.column("held"), "n_tokens": lengths, "n_known": add((by_order[0] > 0).astype(np.int64)), "base": add(np.log10(model.root)), "score": add(model.weights())})

    schema = "k bigint, held boolean, n_tokens bigint, n_known bigint, base double, score double"
    asked = texts.select("block", "k", "t", "held").groupBy("block").cogroup(counts.where("block is not null").select("block", "part", "data").groupBy("block"))
    return asked.applyInArrow(score, schema).select(
        F.col("k").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
