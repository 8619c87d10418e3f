"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

A text is cut by the vocabulary's pattern into pieces, here called words. Each distinct word is a byte array whose
lowest-ranked adjacent pair is merged until no pair has a rank; decoding concatenates the tokens' binary pieces.

Two forms of the same fold:

* :func:`word_tokens` is made of Spark's higher-order functions: ``aggregate`` folds the merges, ranks come from a
  literal map (an array of small maps by hash, for Spark looks a key up in a map by a linear scan). It encodes tables
  of distinct words.
* :func:`encode` and :func:`digests` fold in Python workers over the distinct words of Arrow batches, with a bounded
  memory of words already folded. Texts use this form: the README has the figures that rule the first one out for them.

Ranks are read by the driver from the file that the caller names and broadcast; a vocabulary's size is fixed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import chunks

#: Words that a worker remembers; beyond it begins anew.
REMEMBERED = 300_000
#: Words of more bytes than this are merged by a heap, and not remembered.
LONG = 64
#: Small maps that the literal rank map is dealt into.
MAPS = 1 << 16
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    found = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while found:
        least = min(found)
        if least == _NONE:
            break
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As :func:`_short`, by a heap of (rank, place): the lowest rank first, the leftmost of equals."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], _NONE)) < _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], _NONE)) < _NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop], _NONE)) < _NONE:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: a word that is a token is that token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _short(word, ranks) if len(word) <= LONG else _long(word, ranks)


class Words(dict):
    """Distinct words with their ids, the ids as decimal text, and the bytes the ids stand for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pieces = ranks, {i: b for b, i in ranks.items()}

    def __missing__(self, word: str) -> tuple[list[int], str, bytes]:
        ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
        entry = (ids, ",".join(map(str, ids)), self.decode(ids))
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = entry
        return entry

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


_words: dict[int, Words] = {}


def _of_worker(ranks: Broadcast) -> Words:
    """The worker's words of these ranks; they outlast a batch and a task."""
    if id(ranks.value) not in _words:
        _words.clear()
        _words[id(ranks.value)] = Words(ranks.value)
    return _words[id(ranks.value)]


def _mapped(docs: DataFrame, path: str, pattern: str, key: str, text: str, columns: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut = _of_worker(ranks), regex.compile(pattern)
        for b in batches:
            for start, texts in chunks(b, text):
                rows = [row([words[w] for w in cut.findall(t)]) for t in texts]
                keys = b.column(0).slice(start, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns.values()))], names=[key, *columns])

    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, f"{key} bigint, " + ", ".join(f"{c} {t}" for c, (t, _) in columns.items()))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids array<int>) of every row; a null or empty text has no tokens."""
    columns = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32()))}

    def row(found: list) -> tuple:
        ids = list(chain.from_iterable([w[0] for w in found]))
        return len(ids), ids

    return _mapped(docs, path, pattern, key, text, columns, row)


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids array<int>, decoded string): :func:`encode` with the text that the ids decode to."""
    columns = {"n_tokens": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}

    def row(found: list) -> tuple:
        ids = list(chain.from_iterable([w[0] for w in found]))
        return len(ids), ids, b"".join([w[2] for w in found]).decode("utf-8", "replace")

    return _mapped(docs, path, pattern, key, text, columns, row)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of every row of ids; null ids decode to null, an id outside the vocabulary is an error."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _of_worker(ranks)
        for b in batches:
            out = [None if (x := b.column(1)[i].as_py()) is None else words.decode(x) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=[key, "decoded"])

    return tokens.select(F.col(key).alias(key), F.col(ids).alias(ids)).mapInArrow(run, f"{key} bigint, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): :func:`encode` and :func:`decode`, digested in the worker.

    The first digest is of the decimal ids joined by commas, the second of the bytes the ids decode to.
    """
    columns = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def row(found: list) -> tuple:
        ids = ",".join([w[1] for w in found])
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([w[2] for w in found])).hexdigest()

    return _mapped(docs, path, pattern, key, text, columns, row)


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of maps from hex digits to ranks, at the place of the digits' hash."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for b, i in ranks.items():
        maps[xxhash.xxh64_intdigest(b.hex(), 42) % MAPS][b.hex()] = i
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def word_tokens(spark: SparkSession, words: DataFrame, path: str, word: str = "word") -> DataFrame:
    """(word, ids array<int>) of a table of distinct words, by Spark's higher-order functions alone.

    Bytes are pairs of hex digits, as maps need strings. A null or empty word has no ids.
    """
    ranks = _rank_map(read_ranks(path))
    # items are taken by [], as get() evaluates its array more than once
    rank = lambda s: ranks[F.pmod(F.xxhash64(s), F.lit(MAPS)).cast("int")][s]
    let = lambda value, f: F.transform(F.array(value), f)[0]

    def step(parts: Column, _: Column) -> Column:
        found = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.coalesce(rank(F.concat(x, parts[i + 1])), F.lit(_NONE)))

        def merged(found: Column) -> Column:
            least = F.array_min(found)
            at = F.array_position(found, least).cast("int")
            both = lambda at: F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(parts[at - 1], parts[at])), F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))
            return F.when(least == _NONE, parts).otherwise(let(at, both))

        return F.when(F.size(parts) < 2, parts).otherwise(let(found, merged))

    digits = F.lower(F.hex(F.encode(F.col(word), "utf-8")))
    n = (F.length(digits) / 2).cast("int")
    first = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(digits, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.coalesce(first, F.array().cast("array<string>")), step)
    ids = F.when(rank(digits).isNotNull(), F.array(rank(digits))).otherwise(F.transform(folded, rank))
    return words.select(word, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
