"""The evaluation of generated threats against a catalog, as one plan: match, score, verify, reach."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veriframe.operators import metrics, threats
from veriframe.operators.matching import match, match_actions
from veriframe.tables import THREAT_TYPES, invalid_pairs, mapping


@dataclass
class Evaluation:
    """Lazy tables: nothing runs until one is read."""

    pairs: DataFrame
    scores: DataFrame
    nodes: DataFrame
    citations: DataFrame
    reach: DataFrame


def evaluate(spark: SparkSession, generated: DataFrame, gold: DataFrame, elements: DataFrame, flows: DataFrame, tree_nodes: DataFrame, strict: bool = False, domain: tuple[str, ...] = THREAT_TYPES) -> Evaluation:
    """A threat catalog's evaluation (first framework)."""
    dims = mapping(spark), invalid_pairs(spark)
    pairs = match(generated, gold, flows, strict)
    checks = threats.verified(generated, elements, flows, tree_nodes, *dims)
    classes = threats.reachability(gold, elements, flows, *dims, matched=pairs)
    return Evaluation(pairs, metrics.by_type(generated, gold, pairs, domain), metrics.by_node(generated, gold, pairs), metrics.citation_rates(checks), threats.breakdown(classes))


def evaluate_actions(spark: SparkSession, generated: DataFrame, gold: DataFrame, elements: DataFrame, flows: DataFrame, tree_nodes: DataFrame) -> Evaluation:
    """The second framework: matched by action, scored by parent category, nothing unreachable."""
    dims = mapping(spark), invalid_pairs(spark)
    pairs = match_actions(generated, gold, flows)
    checks = threats.verified(generated, elements, flows, tree_nodes, *dims)
    classes = threats.reachability(gold, elements, flows, *dims, matched=pairs, framework="panoptic")
    return Evaluation(pairs, metrics.by_parent(generated, gold, pairs), metrics.by_node(generated, gold, pairs), metrics.citation_rates(checks), threats.breakdown(classes))
