"""A-01 to A-17, A-24, A-28: counts, rates and repeated-run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.logic import f1, precision, ratio, recall, share, verdict
from veriframe.functions.text import parent_category
from veriframe.tables import THREAT_TYPES


def outcomes(generated: DataFrame, gold: DataFrame, pairs: DataFrame, of_generated: Column, of_gold: Column) -> DataFrame:
    """(category, tp, fp, fn): matched and unmatched generated rows and unmatched gold rows of each category."""
    n = generated.join(pairs.select("gen_index", F.lit(1).alias("_hit")), "gen_index", "left").select(of_generated.alias("category"), F.coalesce("_hit", F.lit(0)).alias("tp"), (1 - F.coalesce("_hit", F.lit(0))).alias("fp"), F.lit(0).alias("fn"))
    g = gold.join(pairs.select(F.col("gold_id").alias("id")).distinct(), "id", "left_anti").select(of_gold.alias("category"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    return n.unionByName(g).groupBy("category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def scored(counts: DataFrame) -> DataFrame:
    """A-04: counts with precision, recall and f1; 0 where a denominator is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", precision(tp, fp)).withColumn("recall", recall(tp, fn)).withColumn("f1", f1(tp, fp, fn))


def over_domain(counts: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """A-01, N1: the rows of a fixed domain, zeros kept; categories outside it vanish."""
    fixed = counts.sparkSession.createDataFrame([(c, i) for i, c in enumerate(domain)], "category string, pos int")
    return F.broadcast(fixed).join(counts, "category", "left").select("category", "pos", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def with_total(counts: DataFrame) -> DataFrame:
    """A-05: the rows and their sum as ``ALL``, so after the restriction to a domain; scored."""
    total = counts.rollup("category").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.grouping("category").alias("_all"))
    total = total.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("category"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return scored(total)


def by_type(generated: DataFrame, gold: DataFrame, pairs: DataFrame, domain: tuple[str, ...] = THREAT_TYPES) -> DataFrame:
    """A-01, A-04, A-05 by threat type."""
    return with_total(over_domain(outcomes(generated, gold, pairs, F.col("threat_type"), F.col("threat_type")), domain))


def by_node(generated: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """A-02: by tree node, over the nodes that occur."""
    return scored(outcomes(generated, gold, pairs, F.col("tree_node"), F.col("tree_node")))


def worst_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    """O-05: the ``n`` nodes with the most misses, ties by node."""
    return nodes.where("fn > 0").orderBy(F.desc("fn"), "category").limit(n)


def by_parent(generated: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """A-03: by parent category of the action; a missed gold row counts under its first action's parent, without actions nowhere."""
    n = generated.where(F.coalesce(F.col("panoptic_action"), F.lit("")) != "")
    g = gold.where(F.size(F.coalesce("panoptic_actions", F.array().cast("array<string>"))) > 0)
    return scored(outcomes(n, g, pairs, parent_category("panoptic_action"), parent_category(F.get("panoptic_actions", F.lit(0)))))


def all_valid(node: str = "node_valid", kind: str = "type_applicable", place: str = "location_valid", position: str = "position_applicable") -> Column:
    """N4: the conjunction in which an unrun position check neither fails nor passes."""
    return F.col(node) & F.col(kind) & F.col(place) & F.coalesce(F.col(position), F.lit(True))


def citation_rates(checks: DataFrame, *by: str) -> DataFrame:
    """A-06: pass rates over all rows; the position's over those that cite one, null if none does."""
    cited = F.col("position_applicable")
    return checks.groupBy(*by).agg(
        share(F.col("node_valid")).alias("node_valid_rate"),
        share(F.col("type_applicable")).alias("type_applicable_rate"),
        share(F.col("location_valid")).alias("location_valid_rate"),
        F.avg(cited.cast("int")).alias("position_applicable_rate"),
        F.count(cited).alias("n_position_cited"),
        share(all_valid()).alias("all_valid_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def gold_free_rates(checks: DataFrame, *by: str) -> DataFrame:
    """A-08: as :func:`citation_rates`, with null where there is no row."""
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return checks.groupBy(*by).agg(mean(F.col("node_valid")).alias("node_valid_rate"), mean(F.col("type_applicable")).alias("type_applicable_rate"), mean(F.col("location_valid")).alias("location_valid_rate"), F.avg(F.col("position_applicable").cast("int")).alias("position_applicable_rate"), mean(all_valid()).alias("all_valid_rate"), F.count(F.lit(1)).alias("n"))


def human_corrected(tp: Column, fp: Column, label: str = "label") -> list[Column]:
    """A-12, aggregates over a worklist: labels extrapolated to all false positives, borderline ones halved; null without labels."""
    spurious, valid, border = (F.count_if(F.col(label) == v) for v in ("spurious", "valid_uncatalogued", "borderline"))
    n = F.count(label)
    scale = F.try_divide(fp.cast("double"), n)
    good = tp + (valid + border * 0.5) * scale
    bad = (spurious + border * 0.5) * scale
    return [
        n.alias("n_labeled"),
        spurious.alias("spurious"),
        valid.alias("valid_uncatalogued"),
        border.alias("borderline"),
        F.when(n > 0, ratio(tp, tp + fp)).alias("precision_raw"),
        F.when(n > 0, ratio(good, good + bad)).alias("precision_corrected"),
        F.when(n > 0, n == fp).alias("is_full_review"),
    ]


def run_stats(rows: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """A-13, A-14: n, mean, sample sd (null for one), least, largest and sorted values; nulls are left out."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_samp(v), digits).alias("sd"), F.round(F.min(v), digits).alias("min"), F.round(F.max(v), digits).alias("max"), F.transform(F.array_sort(F.collect_list(v)), lambda x: F.round(x, digits)).alias("values"))


def paired(cells: DataFrame, block: str, arm: str, value: str, a: str, b: str, *by: str) -> DataFrame:
    """A-15, J-30: over blocks that have both arms the mean and sd of a - b, their number and how often a is larger; two blocks at least."""
    wide = cells.groupBy(*by, block).agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("_b")).dropna(subset=["_a", "_b"])
    d = F.col("_a") - F.col("_b")
    return wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.count_if(d > 0).alias("wins")).where("n >= 2")


def mean_of_means(rows: DataFrame, block: str, value: str, *by: str) -> DataFrame:
    """Z-22: the mean over blocks of the blocks' means."""
    return rows.groupBy(*by, block).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("blocks"))


def position_counts(rows: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """A-16: how many rows at S, fl, D and unset (null, empty or anything else)."""
    p = F.when(F.col(position).isin("S", "fl", "D"), F.col(position)).otherwise("unset")
    return rows.groupBy(*by).agg(*(F.count_if(p == v).alias(v) for v in ("S", "fl", "D", "unset")))


def type_share(rows: DataFrame, by: list[str], kind: str, domain: tuple[str, ...]) -> DataFrame:
    """A-17: percentage of rows of each kind of the domain; 0 where there is no row."""
    total = F.count_if(F.col(kind).isin(*domain))
    return rows.groupBy(*by).agg(*((100 * ratio(F.count_if(F.col(kind) == v), total)).alias(v) for v in domain))


def common_to_all(rows: DataFrame, key: str, group: str) -> DataFrame:
    """A-24, T-04: relational division: (key, n_groups, everywhere) for keys of any group; everywhere: in every group."""
    n = rows.agg(F.count_distinct(group).alias("_all"))
    own = rows.groupBy(key).agg(F.count_distinct(group).alias("n_groups"))
    return own.crossJoin(F.broadcast(n)).select(key, "n_groups", (F.col("n_groups") == F.col("_all")).alias("everywhere"))


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A-22: the most frequent value of each group, of equals the smallest."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(value), F.max("_n").alias("votes"))


def consensus(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A-23: the value on which all rows of a group agree, else empty; and the confidence. No value at all: empty, low."""
    same = F.count_distinct(value) == 1
    return rows.groupBy(*by).agg(F.when(same, F.min(value)).otherwise("").alias(value), F.when(same, "high").otherwise("low").alias("confidence"))


def node_class(node: Column, exact: Column, any_case: Column, parent: Column) -> Column:
    """F-22: how a cited node id resolves; the flags say whether it, its lower case, its parent's lower case are known."""
    blank = F.coalesce(F.lower(F.trim(node)), F.lit("")).isin("", "not applicable", "threat not possible")
    return F.when(blank, "not_an_id").when(exact, "exact").when(any_case, "case_only").when(parent, "below_our_kb").otherwise("unresolvable")


def classified_nodes(citations: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """A-28, F-22: citations with ``class``, by joins to the known nodes."""
    exact = nodes.select(F.col("node_id").alias("_e")).distinct()
    low = nodes.select(F.lower("node_id").alias("_l")).distinct()
    parent = F.lower(F.regexp_replace(F.col(node), r"\.?[^.]*$", ""))
    out = citations.join(exact, F.col(node) == F.col("_e"), "left").join(low, F.lower(node) == F.col("_l"), "left").join(low.select(F.col("_l").alias("_p")), (parent == F.col("_p")) & (parent != ""), "left")
    return out.withColumn("class", node_class(F.col(node), F.col("_e").isNotNull(), F.col("_l").isNotNull(), F.col("_p").isNotNull())).drop("_e", "_l", "_p")


def coverage_validity(classified: DataFrame, *by: str) -> DataFrame:
    """A-28: cells that cite something, and how many of those resolve; abstentions are no errors."""
    c = F.col("class")
    asserted = F.count_if(c != "not_an_id")
    return classified.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), asserted.alias("asserted"), F.count_if(c == "exact").alias("exact"), F.count_if(c == "case_only").alias("case_only"), F.count_if(c == "below_our_kb").alias("below"), ratio(F.count_if(c.isin("exact", "case_only")), asserted).alias("validity"), ratio(F.count_if(c == "exact"), asserted).alias("exact_rate"))


def plain_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """A-28: 2tp / (2tp + fp + fn)."""
    return ratio(2 * tp, 2 * tp + fp + fn)


def with_verdict(rows: DataFrame, *checks: str, name: str = "all_valid") -> DataFrame:
    """A-32: rows with the three-valued conjunction of their checks."""
    return rows.withColumn(name, verdict(*(F.col(c) for c in checks)))


def contiguous(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """A-30: whether ids are 1 to n without gaps or repeats."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("n"), ((F.min(key) == 1) & (F.max(key) == n) & (F.count_distinct(key) == n)).alias("contiguous"))


def top_share(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Kinds of each group with their share of the group, by one window over the grouped counts."""
    n = rows.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
