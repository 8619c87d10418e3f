"""S-27, S-29, Z-10, Z-11, Z-14: building catalogs from literal rows, with what is recorded of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators.metrics import contiguous
from veriframe.tables import THREAT_TYPES


def named_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Z-11, S-27: tuples of a literal table as named rows; a tuple of another length is an error."""
    names = [x.split()[0] for x in schema.split(", ")]
    if bad := [r for r in rows if len(r) != len(names)]:
        raise ValueError(f"{len(bad)} rows don't have the columns {names}")
    return spark.createDataFrame(rows, schema)


def source_rows(gold: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Z-10: gold rows with ``row``, the number of the source row they stand for: an override, else their own id.

    overrides: (key, row); a null row says that there is none.
    """
    o = overrides.select(F.col(key).alias("_k"), F.col("row").alias("_r"), F.lit(True).alias("_o"))
    out = gold.join(o, F.col(key) == F.col("_k"), "left")
    return out.withColumn("row", F.when(F.col("_o"), F.col("_r")).otherwise(F.col(key))).drop("_k", "_r", "_o")


def described(gold: DataFrame, *by: str, kind: str = "threat_type") -> DataFrame:
    """S-29: (by, count, type_distribution): a catalog's size and its numbers by type, in the order of the types."""
    n = gold.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), "n")))).alias("type_distribution"))


def problems(gold: DataFrame, expected: int | None = None, domain: tuple[str, ...] = THREAT_TYPES, required: tuple[str, ...] = ("title",)) -> list[str]:
    """S-29, A-30: what a catalog fails of its builder's regression checks: size, ids 1 to n, known types, no empty field."""
    ids = contiguous(gold, "id").first()
    empty = F.lit(False)
    for c in required:
        empty = empty | (F.trim(F.coalesce(c, F.lit(""))) == "")
    bad = gold.agg(F.count_if(~F.coalesce(F.col("threat_type").isin(*domain), F.lit(False))).alias("types"), F.count_if(empty).alias("empty")).first()
    out = [] if expected in (None, ids["n"]) else [f"{ids['n']} rows, not {expected}"]
    out += [] if ids["contiguous"] else ["ids are not 1 to n"]
    out += [f"{bad['types']} rows of unknown type"] if bad["types"] else []
    return out + ([f"{bad['empty']} rows with an empty field"] if bad["empty"] else [])


def document(gold: DataFrame, scenario: str, source: str) -> DataFrame:
    """S-29: one row ``value``: the catalog as a JSON document with its description; a catalog is as long as people write it."""
    rows = gold.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(*gold.columns).alias("r")))), lambda x: x["r"]).alias("threats"))
    meta = described(gold)
    return rows.crossJoin(meta).select(F.to_json(F.struct(F.struct(F.lit(scenario).alias("scenario"), F.lit(source).alias("source"), "count", "type_distribution").alias("_meta"), "threats")).alias("value"))


def titles(nodes: DataFrame) -> DataFrame:
    """Z-14: (node_id, title) of a tree's nodes, an absent title empty; of a node in several trees the last type's."""
    return nodes.groupBy("node_id").agg(F.coalesce(F.max_by("title", "threat_type"), F.lit("")).alias("title"))


def identity(elements: DataFrame, flows: DataFrame) -> DataFrame:
    """Z-14: (kind, hand_id, derived_id) of a diagram that is a copy: each id stands for itself."""
    each = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").alias("hand_id"), F.col("id").alias("derived_id"))
    return each(elements, "element").unionByName(each(flows, "flow"))


def broken_formula(issues: str | Column = "issues") -> Column:
    """Z-14: whether any issue of a row is of the ranking's formula."""
    return F.exists(issues, lambda i: i.startswith("formula:"))
