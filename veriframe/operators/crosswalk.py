"""J-22, J-24, T-02, T-03, T-05, T-06, Z-12, Z-13: dimensions of two taxonomies against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.text import dotted_prefixes, parent_category


def nearest_ancestor(rows: DataFrame, nodes: DataFrame, node: str = "node", overrides: DataFrame | None = None) -> DataFrame:
    """J-22: rows with ``resolved``: an override, else the node itself or its nearest known ancestor, else null.

    Each id is looked up by its own prefixes, longest first: an equi-join.
    """
    known = nodes.select(F.col("node_id").alias("_k")).distinct()
    ids = rows.select(F.col(node).alias("_n")).where("_n is not null").distinct()
    hit = ids.select("_n", F.posexplode(dotted_prefixes("_n")).alias("_i", "_p")).join(known, F.col("_p") == F.col("_k")).groupBy("_n").agg(F.min_by("_k", "_i").alias("_a"))
    out = rows.join(hit, F.col(node) == F.col("_n"), "left")
    if overrides is None:
        return out.withColumn("resolved", F.col("_a")).drop("_n", "_a")
    o = overrides.select(F.col("node_id").alias("_o"), F.col("target").alias("_t"))
    return out.join(o, F.col(node) == F.col("_o"), "left").withColumn("resolved", F.coalesce("_t", "_a")).drop("_n", "_a", "_o", "_t")


def both_readings(forward: DataFrame, back: DataFrame) -> DataFrame:
    """T-02: the distinct edges (a, b) of two lists, the second read the other way round."""
    return forward.select("a", "b").unionByName(back.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def sides(edges: DataFrame, key: str, other: str) -> DataFrame:
    """T-02: each key with its sorted distinct partners."""
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias("partners"))


def asymmetries(forward: DataFrame, back: DataFrame) -> DataFrame:
    """T-03: (a, only_forward, only_back) for keys whose partners differ between the two lists."""
    f, b = forward.select("a", "b").distinct(), back.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    one = f.exceptAll(b).withColumn("w", F.lit(1)).unionByName(b.exceptAll(f).withColumn("w", F.lit(2)))
    some = lambda w: F.array_sort(F.collect_list(F.when(F.col("w") == w, F.col("b"))))
    return one.groupBy("a").agg(some(1).alias("only_forward"), some(2).alias("only_back"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """T-06: (key, side) of keys that only one table has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def node_diff(old: DataFrame, new: DataFrame, by: str = "threat_type", node: str = "node_id") -> DataFrame:
    """Z-13: (by, added, removed): sorted node ids."""
    o, n = old.select(by, node).distinct(), new.select(by, node).distinct()
    d = n.join(o, [by, node], "left_anti").withColumn("w", F.lit(1)).unionByName(o.join(n, [by, node], "left_anti").withColumn("w", F.lit(2)))
    some = lambda w: F.array_sort(F.collect_list(F.when(F.col("w") == w, F.col(node))))
    return d.groupBy(by).agg(some(1).alias("added"), some(2).alias("removed"))


def audit(gold: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """J-24: gold rows with ``bucket``: consistent, inconsistent or no_actions: is the type among those of its actions' parents?

    crosswalk: (category, threat_type).
    """
    a = gold.select("id", F.explode("panoptic_actions").alias("x")).select("id", parent_category("x", None).alias("category"))
    allowed = a.join(crosswalk, "category").groupBy(F.col("id").alias("_i")).agg(F.collect_set("threat_type").alias("_t"))
    has = F.size(F.coalesce("panoptic_actions", F.array().cast("array<string>"))) > 0
    bucket = F.when(~has, "no_actions").when(F.coalesce(F.array_contains("_t", F.col("threat_type")), F.lit(False)), "consistent").otherwise("inconsistent")
    return gold.join(allowed, F.col("id") == F.col("_i"), "left").withColumn("bucket", bucket).drop("_i", "_t")


def in_order(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows with their number, from 1, in the order of a column without repeats.

    Rows are sorted in ranges that Spark chooses by sampling, and ranges are numbered by their counts, so only one row a
    range meets in a task. The ranges are kept, as the counts and the numbers must be of the same ones.
    """
    r = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()).persist()
    r = r.withColumn("_range", F.shiftright("_at", 33))
    before = r.groupBy("_range").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return r.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before", "_at")


def first_flows(rows: DataFrame, source: str, dest: str, order: str, prefix: str = "GF") -> DataFrame:
    """Z-12: (id, source, destination, first): one flow for each pair of end points, numbered by the arrival of its first row."""
    f = in_order(rows.groupBy(source, dest).agg(F.min(order).alias("first")), "first")
    return f.select(F.concat(F.lit(prefix), F.col("n").cast("string")).alias("id"), F.col(source).alias("source"), F.col(dest).alias("destination"), "first")


def numbered(id_: str | Column) -> Column:
    """O-08: the number in an id, to sort by."""
    return F.regexp_extract(F.col(id_) if isinstance(id_, str) else id_, r"\d+", 0).try_cast("int")


def tree_lines(lines: DataFrame, by: str = "doc") -> DataFrame:
    """S-15, W-08, W-10: (doc, node_id, title, body) from numbered lines of extracted text.

    A line that begins with a dotted node id opens a node; lines up to the next belong to it. A line that ends in a
    hyphen is joined to the next without it. Reading the pages is left to the caller.
    """
    head = r"^([A-Z][a-z]?\.\d+(?:\.\d+)*)\s+(\S.*)$"
    order = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    node = F.nullif(F.regexp_extract("line", head, 1), F.lit(""))
    placed = lines.withColumn("node", node).withColumn("sec", F.sum(node.isNotNull().cast("int")).over(order)).where("sec > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("node").isNull(), F.struct("n", "line"))))
    whole = F.array_join(F.transform(body, lambda x: F.trim(x["line"])), " ")
    return placed.groupBy(by, "sec").agg(F.max("node").alias("node_id"), F.max(F.when(F.col("node").isNotNull(), F.regexp_extract("line", head, 2))).alias("title"), F.regexp_replace(whole, r"(?<=\p{L})- (?=\p{Ll})", "").alias("body")).drop("sec")
