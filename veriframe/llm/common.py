"""What several training-data operators share: written tables, bounded samples, batches of text, components.

Rules that hold for every operator of the subpackage:

* a null text counts as the empty text, rows are never dropped for a null in any column;
* input columns other than the named ones are ignored by the operator, so extra columns with any name are harmless;
* an empty table gives an empty result of the documented schema;
* repeated rows are separate rows with equal results.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.tables import load, spread

#: ASCII white space; a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a temporary local folder with a local master; on a cluster the warehouse, if it is in a store and
    not a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            _own[app] = tempfile.mkdtemp(prefix="veriframe-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if "://" not in warehouse or warehouse.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _own[app] = f"{warehouse}/_veriframe"
    return _own[app]


def written(df: DataFrame, name: str, rows: int | None = None, per_file: int = 1_000_000, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    ``rows``: at most so many rows are to be written; the table then has a file for each ``per_file`` of them, so that
    small tables aren't one small file for each shuffle partition. The table is removed when the driver exits.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    path = f"{shared_folder(spark).rstrip('/')}/veriframe/{name}-{uuid.uuid4().hex}"
    # a table of our own needs no marker of success
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def on_disk(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors' disks, for a table that a step reads several times.

    What a lost executor kept is computed again from the written tables before it; the lineage is not cut. Unlike
    :func:`written` it makes no files in the shared folder. The caller may unpersist it when its readers are done.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the driver does
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(load(spark, sf_dir, name))


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null where the key is null."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


def share_of_hash(*cols: str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


class Sampled(NamedTuple):
    """A text of a sample, with its stratum, the stratum's number of keys (about) and a hash that orders the sample."""

    key: int
    text: str
    stratum: tuple
    rows: int
    order: float


def bounded_sample(rows: DataFrame, docs: DataFrame, strata: list[str], key: str, text: str, most: int, kinds: int, total: int, size: int) -> list[Sampled]:
    """About ``most`` texts of each stratum, chosen by the keys' hashes, whatever the partitions.

    ``rows``: (key, strata), ``docs``: the texts by key. Bounds, whatever the input: the ``kinds`` most frequent strata;
    ``total`` texts of all strata together; one text for each key (that with the smallest hash, where a key repeats);
    ``size`` bytes of text, shared evenly by the strata: what does not fit in its stratum's share is left out.
    """
    spark = rows.sparkSession
    # different keys, about: a key that repeats must not thin out its stratum
    counts = rows.groupBy(*strata).agg(F.approx_count_distinct(key, 0.02).alias("_n"), F.count(F.lit(1)).alias("_m")).orderBy(F.desc("_m"), *strata).limit(kinds).drop("_m").collect()
    if not counts:
        return []
    most = max(1, min(most, total // len(counts)))
    kind = T.StructType([*(T.StructField(f"_s{i}", rows.schema[c].dataType) for i, c in enumerate(strata)), T.StructField("_n", T.LongType()), T.StructField("_i", T.IntegerType())])
    each = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(counts)], kind))
    on = F.lit(True)
    for i, c in enumerate(strata):
        on = on & rows[c].eqNullSafe(each[f"_s{i}"])
    # a threshold on the hash picks somewhat more than ``most``; a repeated key is combined before it is shuffled
    near = rows.join(each, on).where(share_of_hash(key) * F.col("_n") < 1.2 * most + 20)
    picked = near.groupBy(F.col(key).cast("bigint").alias("_k")).agg(F.min(F.struct("_i")).alias("_i"), F.min(share_of_hash(key)).alias("_o")).select("_k", "_i._i", "_o")
    first: dict[int, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["_o"], r["_k"])):
        if len(of := first.setdefault(r["_i"], [])) < most:
            of.append(r)
    chosen = {r["_k"]: r for of in first.values() for r in of}

    def texts(keys: list, what: Column) -> list:
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in keys], "_k bigint"))
        return docs.select(F.col(key).cast("bigint").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(wanted, "_k").groupBy("_k").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), what.alias("x")))["x"].alias("_x")).collect()

    lengths = {r["_k"]: r["_x"] for r in texts(list(chosen), F.octet_length("_t"))}
    keys: list[int] = []
    for of in first.values():
        room = size // len(counts)
        for r in of:
            if (n := lengths.get(r["_k"], room + 1)) <= room:
                room -= n
                keys.append(r["_k"])
    out = []
    for r in texts(keys, F.col("_t")) if keys else ():
        at = chosen[r["_k"]]
        *stratum, n = counts[at["_i"]]
        out.append(Sampled(r["_k"], r["_x"], tuple(stratum), n, at["_o"]))
    return sorted(out, key=lambda x: (x.order, x.key))


def chunks(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most ``most`` characters together, or a single longer text; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, size, out = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py() or ""
        if out and size + len(t) > most:
            yield start, out
            start, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield start, out


def pieces(text: str, most: int = 200_000) -> Iterator[str]:
    """A text in pieces of at most ``most`` characters that end behind a character that is no letter.

    Only a run of ``most`` letters is cut inside.
    """
    at = 0
    while len(text) - at > most:
        end = at + most
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def connected_components(edges: DataFrame, name: str = "components", nodes: int | None = None) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: two integer columns ``a``, ``b``; ``nodes``: how many there can be, for the size of files. Returns (node, component), component the smallest node that can be
    reached, for every node of an edge between two different nodes. Each step is a minimum with map-side combination
    and an equi-join that adaptive execution may split, and its edges are written to the shared folder; only the
    number of steps (logarithmic in the longest path) is known to the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, name, nodes)
    while True:
        unfinished = (
            e.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("root"))
            .union(e.select("v", F.lit(0), F.lit(1)))
            .groupBy("n")
            .agg(F.sum("below").alias("below"), F.max("root").alias("root"))
            .where("below > 1 or (below > 0 and root > 0)")
        )
        if unfinished.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = written(small.where("u <> v").distinct(), name, nodes)
