"""SimHash near-duplicates: BK-trees over shards of fingerprints.

A fingerprint has 64 bits in six blocks. Two fingerprints that differ in at most two bits agree in at least four
blocks, so they meet under one of the fifteen choices of four blocks. Each choice with its blocks' bits is the key of a
shard; a shard's BK-tree is built, and asked for every fingerprint of the shard, in the task that the key's hash names.
(A tree is sent only to the task that asks it. Broadcasting all shard trees to all executors would ship the whole
corpus's fingerprints to each of them, without a bound.) A shard holds at most 2**22 fingerprints, for its key fixes 42
bits or more; exact copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import chunks, connected_components, written

#: Bits of each block, from the lowest; they add up to 64.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A shard with more fingerprints than this is cut by the fixed bits of narrower blocks before trees are built.
TREE = 2048

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _masks(widths: tuple[int, ...], at_least: int) -> list[int]:
    starts = np.cumsum((0, *widths))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(widths, starts)]
    return [sum(c) for c in combinations(blocks, at_least)]


def fingerprints_of(texts: list[str], width: int = 3, seed: int = 42) -> np.ndarray:
    """The texts' fingerprints as unsigned 64-bit integers.

    Words are runs of other than ASCII white space in the text with A-Z lowered; a shingle is ``width`` words, or all
    of them where there are fewer, joined by a space; repeats count. No word: zero. Long texts are counted in pieces.
    """
    out = np.zeros(len(texts), np.uint64)
    h = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        n = len(words)
        if not n:
            continue
        if n <= width:
            out[k] = h(b" ".join(words), seed)
            continue
        buf = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        s, e = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
        total, m = np.zeros(64, np.int64), len(s)
        for a in range(0, m, 50_000):
            part = np.array([h(buf[i:j], seed) for i, j in zip(s[a : a + 50_000], e[a : a + 50_000])], dtype="<u8")
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(total * 2 > m, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint as a signed long) of every row. Null or blank texts: zero."""
    schema = f"{key} bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprints_of(t, width) for _, t in chunks(b, text)]
            got = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(got)], names=[key, "fp"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias(text)).mapInArrow(run, schema)


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Adds a value that is not in the tree; returns its number."""
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = new
                    break
                at = below
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at most ``radius`` away; follows only edges that can lead to one."""
        if not self.values:
            return []
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                todo.extend(kids[x] for x in range(d - radius, d + radius + 1) if x in kids)
        return found


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def forest(fps: list[int], radius: int = 2) -> list[tuple[int, int]]:
    """Pairs of positions, at most len - 1, that connect what links at ``radius`` connect in one shard."""
    union, out = _Union(len(fps)), []

    def tree(members: list[int]) -> None:
        t = BKTree()
        for i in members:
            for j in t.within(fps[i], radius):
                if union.join(i, members[j]):
                    out.append((members[j], i))
            t.add(fps[i])

    if len(fps) <= TREE:
        tree(list(range(len(fps))))
    else:
        for mask in _masks((8,) * 8, 6):
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(fps):
                groups.setdefault(v & mask, []).append(i)
            for g in groups.values():
                if len(g) > 1:
                    tree(g)
    return out


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of representatives that connect the nodes as all links of ``radius`` (2 or less) do.

    ``nodes``: (fp, rep) with distinct fp. A shard gives a spanning forest of its links, so a group of m near copies
    gives fewer than m rows for each key, never m squared.
    """
    if radius > 2:
        raise ValueError("the six blocks find links of at most two bits")
    masks = _masks(BLOCKS, 4)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))
    sharded = nodes.select("fp", "rep", F.explode(keys).alias("k")).select(F.col("k.mask").alias("mask"), F.col("k.bits").alias("bits"), "fp", "rep")
    sharded = sharded.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last key, whose shard may go on in the next batch

        def whole(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(parts, axis=1)
            cut = np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)) + 1
            bounds = np.concatenate(([0], cut, [x.shape[1]]))
            a, b = [], []
            for s in np.flatnonzero(np.diff(bounds) > 1).tolist():
                fps, reps = x[2, bounds[s] : bounds[s + 1]].view(np.uint64).tolist(), x[3, bounds[s] : bounds[s + 1]].tolist()
                for i, j in forest(fps, radius):
                    a.append(reps[i])
                    b.append(reps[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            last = int(np.flatnonzero((x[0] != x[0, -1]) | (x[1] != x[1, -1]))[-1]) + 1 if (x[0, 0], x[1, 0]) != (x[0, -1], x[1, -1]) else 0
            if last:
                yield from whole([*held, x[:, :last]])
                held = [x[:, last:]]
            elif held and (held[0][0, 0], held[0][1, 0]) != (x[0, 0], x[1, 0]):
                yield from whole(held)
                held = [x]
            else:
                held.append(x)
        if held:
            yield from whole(held)

    return sharded.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every row.

    component_id: the smallest key that links of at most ``radius`` differing bits reach, itself included. Rows with
    equal fingerprints are linked, blank texts (fingerprint zero) too. Rows with a null key keep their fingerprint but
    are in no group: their component_id is null. Repeated keys are rows of their own.
    """
    fps = written(fingerprints(docs, key, text, width), "simhash-fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-nodes", fps.count())
    comps = connected_components(links(nodes.where("rep is not null"), radius), "simhash-links", nodes.count())
    groups = nodes.join(comps, nodes["rep"] == comps["node"], "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(groups, "fp", "left").select(
        key,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"),
    )


# Stages on word shingles: texts whose shingle sets are alike.
#
# A radius of two bits finds next to identical texts only. Texts that share 0.8 of their five-word shingles differ in
# about ten bits, and blocks of bits can't find so many. Here a shard is a band of minima of the shingles' hashes; its
# BK-tree is asked with the radius that such texts need, and the shingle sets of what it finds decide.

#: Words of a shingle and least Jaccard similarity of stages.
WIDTH, ALIKE = 5, 0.8
#: Bands and minima of a band. Sets of similarity 0.8 have no band in common in one pair of eight million.
BANDS, MINIMA = 40, 5
#: Differing bits of texts that are alike: 9.7 on average at similarity 0.8, with a deviation of 2.9; more for few shingles.
REACH = 26
#: Hashes of the sets that a task compares, about.
MOST = 2_000_000

_r = np.random.Generator(np.random.PCG64(42))
_TIMES = _r.integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _r.integers(0, 1 << 63, BANDS * MINIMA, np.uint64)
_MIX = _r.integers(0, 1 << 63, (BANDS, MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; words and short texts as in :func:`fingerprints_of`."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h, buf = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([h(buf)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    s, e = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.array([h(buf[i:j]) for i, j in zip(s, e)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _set_fingerprint(x: np.ndarray) -> int:
    """The fingerprint of a set of hashes, as a signed number."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(x), 50_000):
        total += np.unpackbits(x[a : a + 50_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(x), bitorder="little").view("<i8")[0])


def _bands(x: np.ndarray) -> list[int]:
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(x), 256):
        np.minimum(least, (x[a : a + 256, None] * _TIMES + _PLUS).min(0), out=least)
    return (least.reshape(BANDS, MINIMA) * _MIX).sum(1, dtype=np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(k, h, node, n, fp, bands) of every row with a key.

    h: hash of the text. node: digest of the shingle set, which stands for all texts with that set. n: its size. bands:
    none for a set without shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(b, "t"):
                sets = [shingle_set(t, width) for t in texts]
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                keys = pa.array([_bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))
                fp = pa.array([_set_fingerprint(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), b.column(1).slice(start, len(texts)), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), fp, keys], names=["k", "h", "node", "n", "fp", "bands"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "k bigint, h bigint, node bigint, n bigint, fp bigint, bands array<bigint>")


def _nearest(fp: list[int], n: list[int], node: list[int]) -> list[tuple[int, int]]:
    """For each member of a shard the nearest earlier one that can be alike: fewer pairs than members."""
    tree, out = BKTree(), []
    for i, v in enumerate(fp):
        for radius in (0, 3, 8, REACH):
            found = [j for j in tree.within(v, radius) if min(n[i], n[j]) >= ALIKE * max(n[i], n[j])]
            if found:
                j = min(found, key=lambda j: ((fp[j] ^ v).bit_count(), node[j]))  # noqa: B023
                out.append((node[j], node[i]))
                break
        tree.add(v)
    return out


def _across(fp: list[int], sets: list[np.ndarray], comp: list[int], block: list[int], one: int, two: int) -> list[tuple[int, int]]:
    """Places of pairs that link different components of a shard: verified, and no more than connect them.

    The tree says which members of other components are near; of those the whole sets are compared. The largest
    component only answers. one, two: of two different blocks only pairs between them are asked.
    """
    parts: dict[int, list[int]] = {}
    for i, c in enumerate(comp):
        parts.setdefault(c, []).append(i)
    if len(parts) < 2:
        return []
    n = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(n)))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    names = {c: x for x, c in enumerate(parts)}
    union, of = _Union(len(parts)), [names[c] for c in comp]
    tree, order, out = BKTree(), [], []
    for c in sorted(parts, key=lambda c: (-len(parts[c]), c)):
        for i in parts[c] if order else ():
            near = [j for j in (order[x] for x in tree.within(fp[i], REACH)) if min(n[i], n[j]) >= ALIKE * max(n[i], n[j]) and (one == two or block[i] != block[j])]
            if not near:
                continue
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = True
            # shared hashes of all near sets at once
            lengths = n[near]
            first = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) + np.repeat(starts[near] - first, lengths)
            both = np.add.reduceat(mark[flat[at]], first, dtype=np.int64)
            mark[own] = False
            for k in np.flatnonzero(both >= ALIKE * (n[i] + lengths - both)).tolist():
                if union.join(of[i], of[near[k]]):
                    out.append((i, near[k]))
        for i in parts[c]:
            tree.add(fp[i])
            order.append(i)
    return out


def _shared(shards: DataFrame) -> DataFrame:
    """The (shard, node) rows of shards with more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before, and whether it has come out
        out = False
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).to_numpy(zero_copy_only=False)
            keep = np.zeros(len(x), bool)
            same = x[1:] == x[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last.column(0)[0].as_py() == x[0]:
                keep[0] = True
                if not out:
                    yield last
            yield b.filter(pa.array(keep))
            last, out = b.slice(len(x) - 1), bool(keep[-1])

    return shards.select("shard", "node").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard bigint, node bigint")


def _by_shard(rows: DataFrame, keys: list[str], ask) -> DataFrame:
    """(a, b): what ``ask`` finds in the rows of each key, as pairs of nodes; it is given a key and Arrow columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        name = None

        def found() -> Iterator[pa.RecordBatch]:
            pairs = ask(name, pa.Table.from_batches(kept)) if kept else []
            for i in range(0, len(pairs), 100_000):
                a, b = zip(*pairs[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cut, cut[1:]):
                now = tuple(key[:, s].tolist())
                if now != name:
                    yield from found()
                    kept, name = [], now
                kept.append(b.slice(s, e - s))
        yield from found()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _asked(shards: DataFrame) -> DataFrame:
    """(a, b): of each set the nearest of each of its shards. ``shards``: (shard, fp, n, node)."""

    def ask(_: tuple, rows: pa.Table) -> list[tuple[int, int]]:
        fp = rows.column("fp").to_numpy().view(np.uint64).tolist()
        return _nearest(fp, rows.column("n").to_pylist(), rows.column("node").to_pylist()) if len(fp) > 1 else []

    return _by_shard(shards.select("shard", "fp", "n", "node").repartition("shard").sortWithinPartitions("shard", "n", "node"), ["shard"], ask)


def _texts(asked: DataFrame, docs: DataFrame, of_node: DataFrame, key: str, text: str) -> DataFrame:
    """(node, t): a text of each node of ``asked``, written."""
    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return written(texts.join(asked.join(of_node, "node"), ["k", "h"]).dropDuplicates(["node"]).select("node", "t"), "similar-texts", compression="zstd")


def _verified(pairs: DataFrame, docs: DataFrame, of_node: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The pairs whose shingle sets are alike."""
    pairs = written(pairs, "similar-pairs")
    texts = _texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, of_node, key, text)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=256)(lambda t: shingle_set(t, width))
        for b in batches:
            ok = [jaccard(of(b.column(2)[i].as_py() or ""), of(b.column(3)[i].as_py() or "")) >= ALIKE for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "similar-links", pairs.count(), 50_000)


def _links_across(shards: DataFrame, known: DataFrame, docs: DataFrame, of_node: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(a, b): links between the components ``known`` of sets that share a shard: all that connect them.

    A set goes to each of its shards that still has several components, not to each pair. A shard of more than MOST
    hashes is dealt into blocks, and each pair of blocks is a task's.
    """
    named = shards.join(known, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("shard").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.sum("n") / MOST).alias("blocks")).where("x <> y").select("shard", "blocks")
    rows = written(named.join(mixed, "shard"), "similar-mixed")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda o: F.struct(F.least(o, F.col("block")).alias("one"), F.greatest(o, F.col("block")).alias("two")))
    rows = rows.join(_texts(rows.select("node").distinct(), docs, of_node, key, text), "node").select("shard", F.explode(pairs).alias("p"), "block", "fp", "node", "comp", "t")
    rows = rows.select("shard", "p.one", "p.two", "block", "fp", "node", "comp", "t").repartition("shard", "one", "two").sortWithinPartitions("shard", "one", "two", "node")

    def ask(name: tuple, rows: pa.Table) -> list[tuple[int, int]]:
        comp, node = rows.column("comp").to_pylist(), rows.column("node").to_pylist()
        if len(set(comp)) < 2:
            return []
        sets = [shingle_set(t, width) for t in rows.column("t").to_pylist()]
        found = _across(rows.column("fp").to_numpy().view(np.uint64).tolist(), sets, comp, rows.column("block").to_pylist(), name[1], name[2])
        return [(node[i], node[j]) for i, j in found]

    return _by_shard(rows, ["shard", "one", "two"], ask)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(k, h, group, component) of each row with a key: its group by links of similarity ALIKE or more, the group's smallest key.

    Texts with equal shingle sets are linked, blank and null ones too. Each set's nearest in each of its shards is
    verified first, fewer pairs than rows of shards. Then the sets of shards that still have several components are
    compared where they are, so that every two sets of a shard that the tree finds near are in one component or were
    compared. Work grows with the square of a shard's sets that are not linked, rows do not.
    """
    found = written(signatures(docs, key, text, width), "similar-signatures")
    number = found.count()
    of_node = written(found.groupBy("node").agg(F.min(F.struct("k", "h")).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("node", "first.k", "first.h", "n", "fp", "bands"), "similar-nodes", number, 100_000)
    shards = _shared(of_node.select(F.explode("bands").alias("shard"), "node"))
    shards = written(shards.join(of_node.select("node", "n", "fp"), "node"), "similar-shards")
    names = of_node.select("node", "k", "h")
    links = _verified(_asked(shards), docs, names, key, text, width)
    known = connected_components(links, "similar-components", number)
    links = links.union(written(_links_across(shards, known, docs, names, key, text, width), "similar-across", number))
    known = connected_components(links, "similar-components", number)
    of = written(of_node.select("node", "k").join(known, "node", "left").select("node", "k", F.coalesce("component", "node").alias("group")), "similar-groups", number)
    of = of.join(of.groupBy("group").agg(F.min("k").alias("component")), "group").select("node", "group", "component")
    return found.select("k", "h", "node").join(of, "node").select("k", "h", "group", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with the smallest key of their group of similar texts; all columns are kept.

    Rows with a null key stay. Of rows that share the smallest key of a group, the one whose text has the smallest hash
    stays, so the result does not depend on partitions; rows that repeat key and text give one row. Texts of one key
    that are not alike are texts of different groups, and each may stay.
    """
    groups = similar(docs, key, text, width)
    stay = groups.where("k = component").groupBy("group", F.col("k").alias("_k")).agg(F.min("h").alias("_h")).select("_k", "_h").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[key].cast("bigint").alias("_a"), F.xxhash64(docs[text]).alias("_b"))
    kept = rows.join(stay, (rows["_a"] == stay["_k"]) & (rows["_b"] == stay["_h"]), "left_semi").dropDuplicates(["_a", "_b"])
    return kept.unionByName(rows.where(F.col("_a").isNull())).select("_row.*")
