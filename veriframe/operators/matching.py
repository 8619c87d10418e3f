"""J-05 to J-08, J-21, J-27, J-31, W-04, W-07: locating and one-to-one matching.

A greedy loop over two ordered lists whose predicate is equality of a key gives, within each key, the first with the
first, the second with the second: a join on (key, rank). Only predicates that are no equivalence need a fold, and that
is cut by the location, so no task gets more than one location's rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.text import flow_id


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """W-04: of each key the first row in ``order``. All columns are kept; nulls are a key like any other."""
    names = df.columns
    pick = F.min_by(F.struct(*names), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*(F.col(f"_r.{c}").alias(c) for c in names))


def rank_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """W-07: (left_order, right_order) of greedy one-to-one equality matching; null keys match nothing."""
    a = left.select(*keys, F.col(left_order).alias("_l")).dropna(subset=keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_l")))
    b = right.select(*keys, F.col(right_order).alias("_r")).dropna(subset=keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_r")))
    return a.join(b, [*keys, "_n"]).select(F.col("_l").alias(left_order), F.col("_r").alias(right_order))


def located(gold: DataFrame, flows: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """J-05, P-18, N9, N10: gold rows with ``cited`` (the id in their text), ``convention`` and ``flow`` (what it resolves to).

    A catalog in which any row cites a flow is flow-anchored: rows resolve by that id. Otherwise they resolve by their
    end points, to the first such flow in list order. Without flows nothing resolves.
    """
    g = gold.withColumn("cited", flow_id("interaction", wide))
    g = g.crossJoin(F.broadcast(g.agg(F.coalesce(F.bool_or(F.col("cited").isNotNull()), F.lit(False)).alias("_any"))))
    g = g.withColumn("convention", F.when(F.col("_any"), "flow_anchored").otherwise("location_anchored")).drop("_any")
    if flows is None:
        return g.withColumn("flow", F.lit(None).cast("string"))
    by_id = flows.select(F.col("id").alias("_id")).distinct()
    by_ends = flows.groupBy(F.col("source").alias("_s"), F.col("destination").alias("_d")).agg(F.min_by("id", "pos").alias("_f"))
    g = g.join(by_id, F.col("cited") == F.col("_id"), "left").join(by_ends, (F.col("dfd_source_id") == F.col("_s")) & (F.col("dfd_destination_id") == F.col("_d")), "left")
    return g.withColumn("flow", F.when(F.col("convention") == "flow_anchored", F.col("_id")).otherwise(F.col("_f"))).drop("_id", "_s", "_d", "_f")


def match(generated: DataFrame, gold: DataFrame, flows: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """J-06: (gen_index, gold_id): each generated row takes the first free gold row of its type and place.

    Place: in a flow-anchored catalog the cited id as text, whether or not the flow exists; else the resolved flow; with
    no flows at hand the type alone. strict adds the tree node. Of gold rows that share an id only the first can match.
    """
    g = located(first_by(gold, ["id"], ["pos"]), flows)
    anywhere = F.lit("*")
    place = F.when(F.col("convention") == "flow_anchored", F.col("cited")).otherwise(F.col("flow") if flows is not None else anywhere)
    g = g.select(F.col("id").alias("gold_id"), "pos", "threat_type", place.alias("place"), "tree_node", "convention")
    side = F.broadcast(g.select("convention").limit(1).withColumnRenamed("convention", "_c"))
    n = generated.crossJoin(side)
    if flows is None:
        n = n.withColumn("place", F.when(F.col("_c") == "flow_anchored", F.col("flow_id")).otherwise(anywhere))
    else:
        known = flows.select(F.col("id").alias("_k")).distinct()
        n = n.join(known, F.col("flow_id") == F.col("_k"), "left").withColumn("place", F.when(F.col("_c") == "flow_anchored", F.col("flow_id")).otherwise(F.col("_k")))
    keys = ["threat_type", "place"] + ["tree_node"] * strict
    return rank_match(n, g, keys, "gen_index", "pos").join(g.select("pos", "gold_id"), "pos").select("gen_index", "gold_id")


def _first_free(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(gen_index, gold_id): candidates in order, each taking the first free gold row of its group that shares a key.

    candidates: (group, at, keys); gold: (group, at, id, keys). What a candidate may take depends on all before it, so a
    group is walked in one task: first its gold rows, which wait in a queue for each of their keys, then the candidates,
    which pass by. Each gold row leaves each queue once, so the work is in proportion to rows and keys.
    """
    rows = gold.select("group", F.lit(0).alias("side"), F.col("at").cast("bigint").alias("at"), F.col("id").cast("bigint").alias("id"), "keys")
    rows = rows.unionByName(candidates.select("group", F.lit(1).alias("side"), F.col("at").cast("bigint").alias("at"), F.col("at").cast("bigint").alias("id"), "keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, taken = object(), {}, set()
        for b in batches:
            pairs = []
            for g, side, at, i, keys in zip(*(b.column(k).to_pylist() for k in range(5))):
                if g != group:
                    group, waiting, taken = g, {}, set()
                if side == 0:
                    for k in keys or ():
                        waiting.setdefault(k, deque()).append((at, i))
                    continue
                best = None
                for k in keys or ():
                    queue = waiting.get(k, ())
                    while queue and queue[0] in taken:
                        queue.popleft()
                    if queue and (best is None or queue[0] < best):
                        best = queue[0]
                if best:
                    taken.add(best)
                    pairs.append((i, best[1]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["gen_index", "gold_id"])

    return rows.repartition("group").sortWithinPartitions("group", "side", "at", "id").mapInArrow(run, "gen_index bigint, gold_id bigint")


def match_actions(generated: DataFrame, gold: DataFrame, flows: DataFrame) -> DataFrame:
    """J-07: (gen_index, gold_id) where the generated row's action is among the gold row's and the flow is the same.

    Rows without an action take no part. Membership is no equivalence, so each flow's rows are walked in order.
    """
    g = located(first_by(gold, ["id"], ["pos"]), flows).where("flow is not null")
    g = g.select(F.col("flow").alias("group"), F.col("pos").alias("at"), "id", F.col("panoptic_actions").alias("keys"))
    n = generated.where(F.coalesce(F.col("panoptic_action"), F.lit("")) != "").join(flows.select("id").distinct(), F.col("flow_id") == F.col("id"), "left_semi")
    return _first_free(n.select(F.col("flow_id").alias("group"), F.col("gen_index").alias("at"), F.array("panoptic_action").alias("keys")), g)


def unmatched(generated: DataFrame, pairs: DataFrame) -> DataFrame:
    """J-08: generated rows that matched nothing."""
    return generated.join(pairs, "gen_index", "left_anti")


def endpoint(labels: DataFrame, elements: DataFrame, label: str = "label") -> DataFrame:
    """J-21: labels with ``element`` and ``how``: the first word as an id, else the whole label as a name (of equal names the last)."""
    ids = elements.select(F.col("id").alias("_i"))
    names = elements.groupBy(F.col("name").alias("_n")).agg(F.max_by("id", "pos").alias("_e"))
    head = F.element_at(F.split(F.trim(F.regexp_replace(label, r"\s+", " ")), " "), 1)
    out = labels.join(ids, head == F.col("_i"), "left").join(names, F.col(label) == F.col("_n"), "left")
    how = F.when(F.col("_i").isNotNull(), "by id").when(F.col("_e").isNotNull(), "by name").otherwise("unresolved")
    return out.withColumn("element", F.coalesce("_i", "_e")).withColumn("how", how).drop("_i", "_n", "_e")


def match_sets(findings: DataFrame, gold: DataFrame) -> DataFrame:
    """J-21: (gen_index, gold_id): each finding takes the first free gold row of its type that cites one of its flows.

    findings: (gen_index, threat_type, flow_ids array). Walked by threat type, the finest key that both sides share.
    """
    g = first_by(gold, ["id"], ["pos"]).withColumn("cited", flow_id("interaction")).where("cited is not null")
    g = g.select(F.col("threat_type").alias("group"), F.col("pos").alias("at"), "id", F.array("cited").alias("keys"))
    return _first_free(findings.select(F.col("threat_type").alias("group"), F.col("gen_index").alias("at"), F.col("flow_ids").alias("keys")), g)


def reanchored(gold: DataFrame, elements: DataFrame, flows: DataFrame) -> DataFrame:
    """J-27: gold rows with their originator and cited flow in another diagram's ids, and a note where an anchor is lost.

    elements, flows: (hand_id, derived_id); of several derived ids the first in id order counts. Originators may be
    elements or flows; one that is neither is kept. A cited flow without a counterpart loses its tag.
    """
    e = elements.groupBy(F.col("hand_id").alias("_he")).agg(F.min("derived_id").alias("_de"))
    f = flows.groupBy(F.col("hand_id").alias("_hf")).agg(F.min("derived_id").alias("_df"))
    own = gold.withColumn("_cited", flow_id("interaction"))
    out = own.join(e, F.col("originator_id") == F.col("_he"), "left").join(f.select(F.col("_hf").alias("_ho"), F.col("_df").alias("_do")), F.col("originator_id") == F.col("_ho"), "left").join(f, F.col("_cited") == F.col("_hf"), "left")
    tag = F.concat(F.lit("["), F.col("_cited"), F.lit("]"))
    text = F.when(F.col("_cited").isNull(), F.col("interaction")).when(F.col("_df").isNotNull(), F.replace("interaction", tag, F.concat(F.lit("["), F.col("_df"), F.lit("]")))).otherwise(F.trim(F.replace("interaction", tag, F.lit(""))))
    notes = F.concat_ws("; ", F.when(F.coalesce("_de", "_do").isNull() & F.col("originator_id").isNotNull(), F.concat(F.lit("originator "), F.col("originator_id"), F.lit(" has no counterpart"))), F.when(F.col("_cited").isNotNull() & F.col("_df").isNull(), F.concat(F.lit("flow "), F.col("_cited"), F.lit(" has no counterpart"))))
    return out.withColumn("originator_id", F.coalesce("_de", "_do", "originator_id")).withColumn("interaction", text).withColumn("remap_note", F.nullif(notes, F.lit(""))).drop("_cited", "_he", "_de", "_ho", "_do", "_hf", "_df")


def positions(gold: DataFrame, flows: DataFrame) -> DataFrame:
    """P-21, J-31, Z-25: gold rows with ``position``: S, D or fl where the originator is the flow's source, destination or the flow itself."""
    f = flows.select(F.col("id").alias("_f"), F.col("source").alias("_s"), F.col("destination").alias("_d"), "pos")
    f = first_by(f, ["_f"], ["pos"]).drop("pos")
    out = gold.join(f, flow_id("interaction", wide=True) == F.col("_f"), "left")
    o = F.col("originator_id")
    return out.withColumn("position", F.when(o == F.col("_s"), "S").when(o == F.col("_d"), "D").when(o == F.col("_f"), "fl")).drop("_f", "_s", "_d")
