"""Substring dedup by hashed lines and paragraphs.

A text's units are its lines, and paragraphs: from a cut to the first cut that is PARAGRAPH words or more behind it. Text
is cut at the words that rank first of FRAME words in a row: words that begin a line or sentence rank before others, then
the hash of a word and the next decides. Paragraphs begin at cuts that rank first of START words in a row. Cuts depend on
a few words around them only, so two texts that share 51 words or more are cut alike inside them, whatever precedes and
follows, and have a whole paragraph in common. A unit is
normalised (lower case, white space runs to one space) and digested to 128 bits; digests are grouped over all texts, the
occurrence that ranks first by (key, offset) is kept, and the others' characters are removed. A text's own repeats are
found in it, so only its distinct digests are grouped. Offsets are code points of the original text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import chunks, written

#: Lines of fewer words are too short to be told apart from common phrases.
LINE = 5
#: Words of a paragraph, at least; words in a row of which one is a cut; words in a row of which one begins a paragraph.
#: Any common run of START + PARAGRAPH + 2 * FRAME words holds a paragraph: one begins among its first START words and ends
#: within a frame of its length, and up to a frame before the run's end all cuts are the same in both texts.
PARAGRAPH = 16
FRAME = 9
START = 16

_WORD = re.compile(r"\S+")


def _ranked_first(rank: np.ndarray, frame: int) -> np.ndarray:
    """Places of the smallest of each ``frame`` numbers in a row, the leftmost of equals; of fewer numbers the smallest."""
    frame = min(frame, len(rank))
    out = np.zeros(len(rank), bool)
    out[np.arange(len(rank) - frame + 1) + np.lib.stride_tricks.sliding_window_view(rank, frame).argmin(1)] = True
    return np.flatnonzero(out)


def units(text: str, line: int = LINE, paragraph: int = PARAGRAPH) -> list[tuple[int, int, bytes]]:
    """(first word, word behind the last, 16-byte digest) of each unit of a text, in order; no two units are alike."""
    rows = [" ".join(x.split()) for x in text.lower().split("\n")]
    rows = [x for x in rows if x]
    counts = np.array([x.count(" ") + 1 for x in rows], np.int64)
    n = int(counts.sum())
    if n < line:
        return []
    joined = " ".join(rows).encode("utf-8", "surrogatepass")
    words = joined.split(b" ")
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))
    ends = np.cumsum(counts)
    begins = ends - counts
    first = np.zeros(n + 1, bool)
    first[begins] = True
    code = np.frombuffer(joined, np.uint8)
    last = code[stop - 1]
    first[1:] |= (last == 46) | (last == 33) | (last == 63) | ((last == 0xA6) & (code[stop - 2] == 0x80) & (code[stop - 3] == 0xE2))  # . ! ? and the three bytes of …
    h = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    h = (h * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(8)
    h[~first[:n]] |= np.uint64(1 << 63)
    starts, cuts = _ranked_first(h, START), np.append(_ranked_first(h, FRAME), n)
    to = np.searchsorted(cuts, starts + paragraph)
    long = to < len(cuts)
    whole = counts >= line
    found = set(zip(begins[whole].tolist(), ends[whole].tolist())) | set(zip(starts[long].tolist(), cuts[to[long]].tolist()))
    digest, begin, end = xxhash.xxh3_128_digest, start.tolist(), stop.tolist()
    return [(i, j, digest(joined[begin[i] : end[j - 1]])) for i, j in sorted(found)]


def _who(docs: DataFrame, key: str, text: str) -> F.Column:
    """What tells the rows of a table apart and ranks them: the key; with it the text's hash if keys are null or repeat.

    Null keys rank first.
    """
    k = docs[key].cast("bigint")
    if docs.select(k.alias("k")).groupBy("k").count().where("count > 1 or k is null").isEmpty():
        return k
    return F.struct(k.isNotNull().alias("known"), F.coalesce(k, F.lit(0)).alias("k"), F.xxhash64(docs[text]).alias("t"))


def digests(rows: DataFrame, line: int = LINE, paragraph: int = PARAGRAPH) -> DataFrame:
    """(h1, h2, k): the halves of each distinct digest of each row of (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(b, "t"):
                row, found = [], []
                for i, t in enumerate(texts, start):
                    own = {h for _, _, h in units(t, line, paragraph)}
                    row += [i] * len(own)
                    found += own
                h = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(pa.array(row, pa.int64()))], names=["h1", "h2", "k"])

    return rows.mapInArrow(run, f"h1 bigint, h2 bigint, k {rows.schema['k'].dataType.simpleString()}")


def repeats(rows: DataFrame, line: int = LINE, paragraph: int = PARAGRAPH) -> DataFrame:
    """(k, cuts array<bigint>): for each row of (k, t) the digests (first halves) that a row of a smaller k has too.

    Digests are written, as they are read twice. Groups are aggregated before the shuffle and written, one row for each
    that repeats. Digests find their group by an equi-join of two shuffled sides, which adaptive execution splits where
    one line is everywhere.
    """
    found = written(digests(rows, line, paragraph), "units")
    groups = found.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    groups = written(groups, "repeated-units", rows.count(), 20_000)
    return found.join(groups, ["h1", "h2"]).where(F.col("k") != F.col("first")).groupBy("k").agg(F.collect_set("h1").alias("cuts"))


def cut(text: str, cuts: set[int], line: int = LINE, paragraph: int = PARAGRAPH) -> tuple[str, list[tuple[int, int, int]], int]:
    """The text without the units whose digest is in ``cuts`` or came before in it, the merged spans (start, end, words)
    removed, all units.

    cuts: first halves of digests, as signed numbers.
    """
    drop = {x.to_bytes(8, "big", signed=True) for x in cuts}
    all_of = units(text, line, paragraph)
    gone: list[tuple[int, int]] = []
    seen: set[bytes] = set()
    for i, j, h in all_of:
        if h in seen or h[:8] in drop:
            gone.append((i, j))
        seen.add(h)
    if not gone:
        return text, [], len(all_of)
    place = [m.span() for m in _WORD.finditer(text)]
    spans: list[list[int]] = []
    for i, j in gone:
        if spans and i <= spans[-1][1]:  # spans are of words here
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    spans = [[place[i][0], place[j - 1][1], j - i] for i, j in spans]
    kept, at = [], 0
    for a, b, _ in spans:
        kept.append(text[at:a])
        # white space between what is kept before and after a span is not doubled
        while b < len(text) and text[b].isspace() and (a == 0 or text[a - 1].isspace()):
            b += 1
        at = b
    kept.append(text[at:])
    return "".join(kept), [tuple(x) for x in spans], len(all_of)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", line: int = LINE, paragraph: int = PARAGRAPH) -> DataFrame:
    """``docs`` with its repeated units removed from ``text``, and two more columns.

    n_units: the text's units (lines and paragraphs). spans: array of (start, end, words), the code points removed from
    the original text, merged and in order, and how many words they are. Every row stays, with an empty text if all of it occurs earlier; a null text
    stays null. Rows with a null key rank first, by their texts' hashes; so do different texts of one key among each
    other. Rows that repeat key and text count as one document: each keeps its first occurrence of a unit. Columns that
    are named like the two new ones are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_units", "spans")))
    order = docs.columns
    who = _who(docs, key, text)
    cuts = repeats(docs.select(who.alias("k"), docs[text].alias("t")), line, paragraph).withColumnRenamed("k", "_k")
    rows = docs.select(F.struct(*(docs[c] for c in order)).alias("_row"), who.alias("_j"))
    both = rows.join(cuts, rows["_j"] == cuts["_k"], "left").select("_row", "cuts")
    row_type = both.schema["_row"].dataType
    schema = T.StructType([*row_type.fields, T.StructField("n_units", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())])))])
    at = order.index(text)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(0).flatten()
            texts, spans, n = [], [], []
            for i in range(b.num_rows):
                t = parts[at][i].as_py()
                out = (None, [], 0) if t is None else cut(t, set(b.column(1)[i].as_py() or ()), line, paragraph)
                texts.append(out[0])
                spans.append([{"start": x, "end": y, "words": w} for x, y, w in out[1]])
                n.append(out[2])
            parts[at] = pa.array(texts, parts[at].type)
            yield pa.RecordBatch.from_arrays([*parts, pa.array(n, pa.int64()), pa.array(spans, span)], names=[*order, "n_units", "spans"])

    return both.mapInArrow(run, schema)
