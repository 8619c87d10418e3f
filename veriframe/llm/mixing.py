"""Mixing sources to target weights: hash-threshold histograms, in DataFrame operations only.

The words of each source are summed by the leading hash digits of its documents. A window over these few sums finds the
bucket in which the source's budget runs out; only that bucket's documents are summed again by the next digits. After
three rounds a bucket holds a document or two, and a document is taken by comparing its digits with its source's
threshold: no sort, and a larger budget's documents contain a smaller one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import WORD, on_disk, written

#: Weights of the sources by code point, null last; they repeat.
WEIGHTS = (5.0, 2.0, 1.0)
#: All targets together, as a share of all words.
BUDGET = 1.5
#: A target's limit, in its source's words.
REPEATS = 2.0
#: Hash digits of each round.
DIGITS = 3
ROUNDS = 3
#: Thresholds of at most so many sources are broadcast (under 10 MB); those of more are joined by a shuffle.
FEW = 50_000


def words_of(text: str | Column) -> Column:
    """Number of runs of other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def digits_of(key: str | Column) -> Column:
    """The hash of a document: hex digits of the MD5 of its key as text (null: of the empty text)."""
    return F.md5(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Targets share ``budget`` of all words by weight, none over ``repeats`` times its source's words; what is over goes
    to the others by weight until none is above. Sources reach their limit in the order of limit by weight, so running
    sums in that order give the level at which sharing ends. One row a source: the windows see as many rows as there
    are sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    own = own.withColumn("limit", repeats * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order, everything = Window.orderBy("ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("level", level)
    # the first source, in this order, whose limit is not under the level that the ones before leave
    final = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return own.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("final"))).alias("target"))


def _joined(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    small = per_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], budget: float, repeats: float) -> tuple[DataFrame, DataFrame, bool]:
    """Each document's (key, source, size, h); each source's target and threshold; whether the sources are few."""
    rows = on_disk(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words_of(text).alias("size"), F.substring(digits_of(key), 1, DIGITS * ROUNDS).alias("h")))
    goal = written(targets(rows, weights, budget, repeats), "mix-targets")
    sources = goal.count()
    few = sources <= FEW
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = goal.withColumn("base", base).withColumn("left", F.when(F.col("source_size") > 0, F.col("target") - F.col("base") * F.col("source_size")).otherwise(F.lit(0.0))).withColumn("prefix", F.lit(""))
    for r in range(1, ROUNDS + 1):
        inside = _joined(rows, state.select("source", "prefix"), few).where(F.col("h").startswith(F.col("prefix")))
        sums = inside.groupBy("source", F.substring("h", 1, DIGITS * r).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # the last bucket that begins within what is left is the boundary
        sums = _joined(sums, state.select("source", "left"), few).where("before <= left")
        edge = sums.groupBy("source").agg(F.max(F.struct("bucket", "before", "words")).alias("edge"))
        rest = (F.col("left") - F.col("edge.before")).alias("left")
        state = written(_joined(edge, state.drop("prefix", "words"), few).select("source", "source_size", "target", "base", rest, F.col("edge.bucket").alias("prefix"), F.col("edge.words").alias("words")), "mix-round", sources)
    # the last bucket is taken or not, whichever is closer
    extra = F.when(F.col("base") >= repeats, "").when(F.col("words") - F.col("left") < F.col("left"), F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix"))
    return rows, written(state.select("source", "source_size", "target", "base", extra.alias("below")), "mix-thresholds", sources), few


def _copies() -> Column:
    return (F.col("base") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """(key, size, source_size, target, taken, copies) of every row.

    A document is taken floor(target / source_size) times, once more if its hash is under its source's threshold; the
    threshold is the one that brings the source's words closest to the target (below it in a tie). ``taken`` is size
    times copies. A null source is a source of its own; a null text has size 0; rows of a source with equal keys share
    a hash and so are taken alike. A source without words has target 0 and none of its documents are taken.
    """
    rows, state, few = thresholds(docs, key, text, source, weights, budget, repeats)
    out = _joined(rows, state, few).withColumn("copies", _copies())
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` takes it; all columns are kept, texts are not shuffled."""
    _, state, few = thresholds(docs, key, text, source, weights, budget, repeats)
    all_of = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    rows = docs.select(all_of, docs[source].alias("source"), F.substring(digits_of(docs[key]), 1, DIGITS * ROUNDS).alias("h"))
    return _joined(rows, state, few).select("_row", F.explode(F.array_repeat(F.lit(0), _copies())).alias("_copy")).select("_row.*")
