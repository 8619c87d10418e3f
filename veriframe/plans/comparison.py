"""P-19, P-20, A-29, Z-15, Z-17: evaluating threats on a derived diagram beside the hand-made one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions.logic import share
from veriframe.operators import threats
from veriframe.operators.matching import match
from veriframe.operators.metrics import all_valid
from veriframe.tables import invalid_pairs, mapping

MODES = ("grounded", "rag", "ungrounded")


def cites_facts(elements: DataFrame, flows: DataFrame, *by: str) -> DataFrame:
    """P-19: (by, cites_facts): whether anything in a diagram cites a fact by its id."""
    cites = lambda df: df.select(*by, F.coalesce(F.exists("provenance", lambda p: p["fact_id"].isNotNull()), F.lit(False)).alias("c"))
    return cites(elements).unionByName(cites(flows)).groupBy(*by).agg(F.bool_or("c").alias("cites_facts"))


def same_flow_ids(derived: DataFrame, hand: DataFrame, *by: str) -> DataFrame:
    """P-19: (by, same_ids): whether two diagrams have exactly the same flow ids; containing them is not enough.

    derived, hand: (by, id). A diagram with flows on one side only differs.
    """
    side = lambda df, n: df.select(*by, "id").distinct().withColumn(n, F.lit(1))
    both = side(derived, "_d").join(side(hand, "_h"), [*by, "id"], "full")
    return both.groupBy(*by).agg((F.count(F.lit(1)) == F.count_if(F.col("_d").isNotNull() & F.col("_h").isNotNull())).alias("same_ids"))


def gold_route(cites: Column, same: Column) -> Column:
    """P-20: which catalog a derived diagram can be scored on.

    Re-anchored through the facts that it cites; without any, the hand-made catalog as it is if the flow ids are the
    same, else none: sharing some ids is not sharing what they stand for.
    """
    return F.when(F.coalesce(cites, F.lit(False)), "re-anchored").when(F.coalesce(same, F.lit(False)), "verbatim").otherwise("unscorable")


def recall_row(spark: SparkSession, generated: DataFrame, gold: DataFrame, elements: DataFrame, flows: DataFrame, tree_nodes: DataFrame) -> DataFrame:
    """A-29: one row of n_generated, n_gold, the reachability classes, raw and reachable recall and the share of valid citations.

    gold may be a part of a catalog, as the rows that another diagram can be anchored to.
    """
    dims = mapping(spark), invalid_pairs(spark)
    pairs = match(generated, gold, flows)
    reach = threats.breakdown(threats.reachability(gold, elements, flows, *dims, matched=pairs))
    checks = threats.verified(generated, elements, flows, tree_nodes, *dims)
    rates = checks.agg(F.count(F.lit(1)).alias("n_generated"), F.coalesce(share(all_valid()), F.lit(0.0)).alias("citation_all_valid"))
    n_gold = F.col("matched") + F.col("reachable_but_missed") + F.col("structurally_unreachable") + F.col("unresolved_location")
    return reach.crossJoin(rates).select("n_generated", n_gold.alias("n_gold"), "matched", "reachable_but_missed", "structurally_unreachable", "unresolved_location", "raw_recall", "reachable_recall", "citation_all_valid")


def compared(rows: dict[tuple[str, str], DataFrame], spark: SparkSession, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Z-15: (mode, side, the columns of :func:`recall_row`) of each mode and side; a mode without any row is there with nulls."""
    named = [df.select(F.lit(m).alias("mode"), F.lit(s).alias("side"), "*") for (m, s), df in rows.items()]
    domain = spark.createDataFrame([(m, i) for i, m in enumerate(modes)], "mode string, _o int")
    if not named:
        return domain.select("mode")
    return domain.join(reduce(DataFrame.unionByName, named), "mode", "left").orderBy("_o", "side").drop("_o")


def cell_metrics(evaluation, **labels: str) -> DataFrame:
    """Z-17: the row that a sweep records for one cell: its labels, the total of the scores, citations and reach."""
    total = evaluation.scores.where("category = 'ALL'").select("tp", "fp", "fn", "precision", "recall", "f1")
    return total.crossJoin(evaluation.citations).crossJoin(evaluation.reach).select(*(F.lit(v).alias(k) for k, v in labels.items()), "*")


def served(requested: str, answered: str | None) -> str:
    """Z-16: the model or retriever that answered, which must be the one asked for."""
    if answered != requested:
        raise ValueError(f"asked for {requested!r}, answered by {answered!r}")
    return answered


