"""Near-duplicate embeddings by sorted projection passes.

Each vector has a sketch of SKETCH random hyperplane hashes, computed once. A pass reads some of these hashes in an order
of its own, as a word; vectors are ordered by (label, word, id), and each is compared with its WIDTH followers. Vectors
near each other differ in few hashes, so in some pass they stand close. Where more vectors than that agree in the word's
first PREFIX hashes, all that agree are compared; runs of over RUN are split by further hashes first, so the work of a
pass stays in proportion to the rows.

Sketches are sorted first. Only rows whose sketch is near a neighbour's are sorted again with their vectors, compared by
cosine, and united in the task; a pass so gives fewer pairs than rows. The orders are range partitionings by the full
sort key of a written table, so many equal words spread over partitions; neighbours across a partition's end are left to
other passes.

The number of links is counted after the groups are known: linked vectors share a group. A group's vectors are dealt into
cells by the first hashes of their sketches and cells into blocks; two blocks are compared only if their centres and radii
allow a link, so a long chain costs as much as it has members. Only counts leave the workers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import connected_components, written

PASSES = 16
WIDTH = 16
#: Hashes of a sketch; each pass has PREFIX of its own to begin its words with.
SKETCH = 256
PREFIX = 14
#: Hashes of a word: enough to order a table of any size.
BITS = 48
#: Vectors that are all compared with each other where their words begin alike.
RUN = 1024
#: Vectors of a block when links are counted: at least, and at most in groups of over 32 times as many.
BLOCK, LARGE_BLOCK = 64, 4096
#: Rows and bytes of the partitions that a pass is sorted into, about.
SORTED, SORTED_BYTES = 200_000, 64_000_000
SEED = 7


def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, SKETCH))


def _order(number: int) -> np.ndarray:
    """The hashes of a pass's word, the first at its highest bit."""
    own = np.arange(number * PREFIX, (number + 1) * PREFIX) % SKETCH
    rest = np.random.default_rng([SEED, 0, number]).permutation(np.setdiff1d(np.arange(SKETCH), own))
    return np.concatenate([own, rest[: BITS - PREFIX]])


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of an array of lists of equal length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector: str) -> Column:
    v = F.col(vector)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def _far(least: float) -> int:
    """Hashes in which vectors of cosine ``least`` may differ: six standard deviations over the mean."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def _runs(group: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of sorted rows that are all to be compared, where a window of WIDTH does not reach.

    group: numbers of the (pass, label, dimensions) of each row, ascending.
    """
    todo = np.arange(len(word))
    for bits in range(PREFIX, BITS + 1):
        if not len(todo):
            return
        w, g = word[todo] >> (BITS - bits), group[todo]
        begin = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (g[1:] != g[:-1]) | (np.diff(todo) > 1))))
        size = np.diff(np.append(begin, len(todo)))
        for b, n in zip(begin[(size > WIDTH + 1) & (size <= RUN)].tolist(), size[(size > WIDTH + 1) & (size <= RUN)].tolist()):
            yield int(todo[b]), int(todo[b]) + n
        if bits == BITS:  # more vectors than RUN whose whole words are equal: in pieces that overlap
            for b, n in zip(begin[size > RUN].tolist(), size[size > RUN].tolist()):
                for i in range(0, n - RUN // 2, RUN // 2):
                    yield int(todo[b]) + i, int(todo[b]) + min(n, i + RUN)
        todo = todo[np.repeat(size > RUN, size)]


def _sorted_part(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a partition, whose number is bounded."""
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks() if some else None


def _groups(rows: pa.Table) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for name in ("pass", "label", "dims"):
        codes = rows.column(name).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def candidates(vectors: DataFrame, least: float, passes: int = PASSES, width: int = WIDTH) -> DataFrame:
    """(a, b): verified pairs that connect what the passes find; fewer rows than vectors for each pass.

    ``vectors``: (id, label, dims, vector), all usable.
    """
    label = vectors.schema["label"].dataType.simpleString()
    far = _far(least)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [_order(p) for p in range(passes)]
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for n in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == n)))
                bits = _matrix(part.column(3)) @ _planes(int(n)) > 0
                sketch = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                for p, order in enumerate(orders):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), p, np.int32)), pa.array(bits[:, order] @ weight), *part.columns[:3], sketch], names=["pass", "word", "id", "label", "dims", "sketch"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sorted_part(batches)
        if rows is None:
            return
        group, word = _groups(rows), rows.column("word").to_numpy()
        s = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(word), -1)
        keep = np.zeros(len(word), bool)
        for k in range(1, min(width, len(word) - 1) + 1):
            hit = np.flatnonzero((group[:-k] == group[k:]) & (np.bitwise_count(s[:-k] ^ s[k:]).sum(1, dtype=np.int64) <= far))
            keep[hit] = keep[hit + k] = True
        for a, b in _runs(group, word):
            x = s[a:b]
            for i in range(0, len(x), 256):
                hit = np.bitwise_count(x[i : i + 256, None] ^ x[None]).sum(2, dtype=np.int64) <= far
                hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
                keep[a + i : a + i + len(hit)] |= hit.any(1)
        yield from rows.select(["pass", "word", "id", "label", "dims"]).filter(pa.array(keep)).to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sorted_part(batches)
        if rows is None:
            return
        group, word, ids = _groups(rows), rows.column("word").to_numpy(), rows.column("id").to_numpy()
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        column = rows.column("vector").combine_chunks()
        up = np.arange(len(ids))
        a, b = [], []

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def join(i: int, j: int) -> bool:
            p, q = find(i), find(j)
            if p == q:
                return False
            up[max(p, q)] = min(p, q)
            a.append(ids[i])
            b.append(ids[j])
            return True

        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            x = _matrix(column.slice(s, e - s))
            for k in range(1, min(width, len(x) - 1) + 1):
                for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= least).tolist():
                    join(s + i, s + i + k)
            for lo, hi in _runs(group[s:e], word[s:e]):
                root = np.array([find(s + i) for i in range(lo, hi)])
                for i in range(hi - lo):
                    hit = np.flatnonzero(x[lo + i + 1 : hi] @ x[lo + i] >= least) + i + 1
                    for j in hit[np.unique(root[hit], return_index=True)[1]].tolist() if len(hit) else ():
                        if root[j] != root[i] and join(s + lo + i, s + lo + j):
                            root[(root == root[i]) | (root == root[j])] = min(root[i], root[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    order = ["pass", "label", "dims", "word", "id"]
    plain = f"pass int, word bigint, id bigint, label {label}, dims int"
    n, dims = vectors.agg(F.count(F.lit(1)), F.max("dims")).first()
    words = written(vectors.select("id", "label", "dims", "vector").mapInArrow(sketched, f"{plain}, sketch binary"), "embedding-words")
    parts = max(1, -(-n * passes // SORTED))
    kept = words.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(near, plain)
    kept = written(kept.join(vectors.select("id", "vector"), "id"), "embedding-near", n * passes, SORTED).select(*order, "vector")
    parts = max(1, -(-kept.count() // max(1, min(SORTED, SORTED_BYTES // (8 * max(1, dims or 1) + 40)))))
    return kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(linked, "a bigint, b bigint")


def _counted(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the vectors of one pair of blocks; a block with itself counts all its pairs."""
    x = np.array(pdf["vector"].tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    first = (pdf["block"] == pdf["one"]).to_numpy()
    copies = pdf["copies"].to_numpy()
    if pdf["one"].iat[0] == pdf["two"].iat[0]:
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        n = near @ copies
    else:
        near = x[first] @ x[~first].T >= least
        n = np.empty(len(x), np.int64)
        n[first], n[~first] = near @ copies[~first], near.T @ copies[first]
    return pd.DataFrame({"id": pdf["id"], "n": n})


def _ball(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centre of a block's unit vectors and the largest angle from it."""
    x = np.array(pdf["vector"].tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    c = x.mean(0)
    c /= max(float(np.sqrt(c @ c)), 1e-300)
    return pd.DataFrame({"component": pdf["component"].iloc[:1], "block": pdf["block"].iloc[:1], "centre": [c.tolist()], "radius": [float(np.arccos(np.clip((x @ c).min(), -1, 1)))]})


def _meeting(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of blocks that can hold a link; the rows of one part of a component's blocks are marked ``own``."""
    own = pdf[pdf["own"]]
    c, r = np.array(pdf["centre"].tolist()), pdf["radius"].to_numpy()
    oc, orad = np.array(own["centre"].tolist()), own["radius"].to_numpy()
    one, two = [], []
    for i in range(0, len(own), 512):
        apart = np.arccos(np.clip(oc[i : i + 512] @ c.T, -1, 1))
        p, q = np.nonzero((apart <= math.acos(least) + orad[i : i + 512, None] + r[None] + 1e-6) & (own["block"].to_numpy()[i : i + 512, None] <= pdf["block"].to_numpy()[None]))
        one.append(own["block"].to_numpy()[i + p])
        two.append(pdf["block"].to_numpy()[q])
    return pd.DataFrame({"component": pdf["component"].iat[0], "one": np.concatenate(one or [np.zeros(0, np.int64)]), "two": np.concatenate(two or [np.zeros(0, np.int64)])})


def _links(distinct: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """(id, n): how many other vectors, copies counted, each vector of a group links with."""
    nodes = distinct.count()
    members = written(comps.union(comps.select("component", "component").distinct().toDF("id", "component")).distinct(), "embedding-members", nodes)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    # cells by the first hash bits (of the first pass's word), so that a block's vectors are near each other
    first = _order(0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for n in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == n)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((_matrix(part.column(2)) @ _planes(int(n)) > 0)[:, first] @ weight)], names=["id", "word"])

    cells = distinct.select("id", "dims", "vector").join(members, "id", "left_semi").mapInArrow(words, "id bigint, word bigint")
    each = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE_BLOCK), F.ceil(F.col("m") / 32)))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / each))).cast("int")
    placed = members.join(sizes, "component").join(cells, "id").withColumn("each", each).withColumn("cell", F.floor(F.col("word") / F.pow(F.lit(2.0), F.lit(BITS) - bits)).cast("bigint"))
    placed = written(placed.select("id", "component", "m", "each", "cell"), "embedding-cells", nodes)
    full = placed.groupBy("component", "cell").agg(F.ceil(F.count(F.lit(1)) / F.first("each")).alias("subs"))
    placed = placed.join(full, ["component", "cell"]).select("id", "component", "m", F.when(F.col("m") <= F.col("each"), F.lit(0)).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("subs")))).alias("block"))
    placed = written(placed.join(distinct.select("id", "copies", "vector"), "id"), "embedding-blocks", nodes, 100_000)
    single, many = F.col("m") <= F.lit(BLOCK), F.col("m") > F.lit(BLOCK)
    small = placed.where(single).select("component", F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("two"), "block", "id", "copies", "vector")
    balls = placed.where(many).select("component", "block", "vector").groupBy("component", "block").applyInPandas(_ball, "component bigint, block bigint, centre array<double>, radius double")
    balls = written(balls, "embedding-balls", nodes)
    # a component's blocks are compared in parts of 512
    parts = balls.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / 512).alias("parts"))
    balls = balls.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    balls = balls.select("component", "part", "block", "centre", "radius", (F.pmod(F.xxhash64("block"), F.col("parts")) == F.col("part")).alias("own"))
    pairs = written(balls.groupBy("component", "part").applyInPandas(lambda pdf: _meeting(pdf, least), "component bigint, one bigint, two bigint"), "embedding-pairs", nodes)
    sides = pairs.select("component", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    large = placed.where(many).join(sides, ["component", "block"]).select("component", "one", "two", "block", "id", "copies", "vector")
    # dealt by the pair of blocks: a large group's pairs would otherwise meet where its component does
    spread = small.unionByName(large).repartition("component", "one", "two")
    return spread.groupBy("component", "one", "two").applyInPandas(lambda pdf: _counted(pdf, least), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, passes: int = PASSES, width: int = WIDTH) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows with equal, non-null labels and vectors of equal length link where their cosine, in double precision, is at
    least ``least``. Null, empty, zero vectors and those with a null or non-finite component link with nothing, nor do
    rows with a null label. n_links: the other rows that a row links with directly, copies included. component_id: the
    smallest key that links reach. kept: the key is that smallest. Equal vectors are compared once. A null key is in no
    group: no links, component_id null, kept. Rows that repeat a key are counted as so many rows.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    usable = rows.where(F.col("key").isNotNull() & F.col("label").isNotNull() & _usable("vector"))
    # copies count once; adding 0 makes -0 equal to 0
    element = rows.schema["vector"].dataType.elementType
    plain = F.transform("vector", lambda x: x + F.lit(0).cast(element))
    distinct = usable.groupBy("label", plain.alias("vector")).agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct.withColumn("dims", F.size("vector")).withColumn("hash", F.xxhash64("label", "vector")).withColumn("more", F.xxhash64(F.lit(1), "label", "vector")), "embedding-vectors", vectors.count(), 100_000)
    comps = connected_components(candidates(distinct, least, passes, width), "embedding-links", distinct.count())
    comps = comps.withColumnRenamed("node", "id")
    of_vector = distinct.join(_links(distinct, comps, least), "id", "left").join(comps, "id", "left")
    of_vector = of_vector.select("id", F.col("hash").alias("_h"), F.col("more").alias("_m"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # rows find their vector by 128 bits of hash, so that vectors need not move again
    use = F.col("key").isNotNull() & F.col("label").isNotNull() & _usable("vector")
    wide = rows.select("key", F.when(use, F.xxhash64("label", plain)).alias("hash"), F.when(use, F.xxhash64(F.lit(1), "label", plain)).alias("more"))
    out = wide.join(of_vector, (F.col("hash") == F.col("_h")) & (F.col("more") == F.col("_m")), "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
