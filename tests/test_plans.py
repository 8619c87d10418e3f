"""Catalog building and the comparison of diagrams."""

import json

import pytest
from pyspark.sql import functions as F

from veriframe.operators import accept, crosswalk, matching
from veriframe.plans import comparison
from veriframe.plans.evaluation import evaluate
from veriframe.sources import catalog

GOLD = "id int, threat_type string, title string"


def test_named_rows(spark):
    rows = catalog.named_rows(spark, [(1, "L", "a"), (2, "I", "b")], GOLD)
    assert [r.asDict() for r in rows.orderBy("id").collect()] == [{"id": 1, "threat_type": "L", "title": "a"}, {"id": 2, "threat_type": "I", "title": "b"}]
    with pytest.raises(ValueError, match="1 rows"):
        catalog.named_rows(spark, [(1, "L", "a"), (2, "I")], GOLD)


def test_catalog_checks_and_document(spark):
    good = catalog.named_rows(spark, [(2, "I", "b"), (1, "L", "a")], GOLD)
    assert catalog.problems(good, 2) == []
    bad = catalog.named_rows(spark, [(1, "L", "a"), (3, "X", " ")], GOLD)
    assert catalog.problems(bad, 3) == ["2 rows, not 3", "ids are not 1 to n", "1 rows of unknown type", "1 rows with an empty field"]
    doc = json.loads(catalog.document(good, "s", "by hand").first()["value"])
    assert doc["_meta"] == {"scenario": "s", "source": "by hand", "count": 2, "type_distribution": {"I": 1, "L": 1}}
    assert [t["id"] for t in doc["threats"]] == [1, 2]


def test_source_rows_with_overrides(spark):
    gold = spark.range(1, 5).withColumn("id", F.col("id").cast("int"))
    over = spark.createDataFrame([(2, 7), (3, None)], "id int, row int")
    assert {r["id"]: r["row"] for r in catalog.source_rows(gold, over).collect()} == {1: 1, 2: 7, 3: None, 4: 4}


def test_flow_ids_that_are_only_contained_are_not_the_same(spark):
    hand = spark.createDataFrame([("DF1",), ("DF2",)], "id string")
    more = spark.createDataFrame([("DF1",), ("DF2",), ("DF3",)], "id string")
    assert comparison.same_flow_ids(hand, hand).first()["same_ids"] and not comparison.same_flow_ids(more, hand).first()["same_ids"]
    route = spark.range(1).select(comparison.gold_route(F.lit(True), F.lit(False)), comparison.gold_route(F.lit(None), F.lit(True)), comparison.gold_route(F.lit(False), F.lit(None)))
    assert tuple(route.first()) == ("re-anchored", "verbatim", "unscorable")


def test_served():
    assert comparison.served("m", "m") == "m"
    with pytest.raises(ValueError, match="answered by 'n'"):
        comparison.served("m", "n")


def test_rows_of_a_sweep_and_of_a_comparison(spark):
    el = spark.createDataFrame([("EE1", "ExternalEntity", "U", 1), ("P1", "Process", "P", 2)], "id string, type string, name string, pos int")
    fl = spark.createDataFrame([("DF1", "EE1", "P1", 1)], "id string, source string, destination string, pos int")
    gold = spark.createDataFrame([(1, 1, "x [DF1]", "L", "L.1"), (2, 2, "x [DF9]", "L", "L.1"), (3, 3, "x [DF1]", "I", "I.1")], "id int, pos int, interaction string, threat_type string, tree_node string").withColumns({c: F.lit(None).cast("string") for c in ("dfd_source_id", "dfd_destination_id")})
    gen = spark.createDataFrame([(0, "DF1", "EE1", "L", "L.1", "S")], "gen_index int, flow_id string, originator_id string, threat_type string, tree_node string, position string")
    nodes = spark.createDataFrame([("L", "L.1")], "threat_type string, node_id string")
    row = comparison.recall_row(spark, gen, gold, el, fl, nodes)
    got = row.first()
    assert (got["n_generated"], got["n_gold"], got["matched"], got["reachable_but_missed"], got["unresolved_location"]) == (1, 3, 1, 1, 1)
    assert got["raw_recall"] == pytest.approx(1 / 3) and got["reachable_recall"] == 0.5 and got["citation_all_valid"] == 1.0
    out = comparison.compared({("rag", "derived"): row}, spark).collect()
    assert [(r["mode"], r["side"]) for r in out] == [("grounded", None), ("rag", "derived"), ("ungrounded", None)]
    cell = comparison.cell_metrics(evaluate(spark, gen, gold, el, fl, nodes), model="m", run="1").first()
    assert (cell["model"], cell["run"], cell["tp"], cell["fn"], cell["matched"]) == ("m", "1", 1, 2, 1)


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 10007,) for i in range(3000)], "at bigint").repartition(5)
    got = {r["at"]: r["n"] for r in crosswalk.in_order(rows, "at").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(got))} and len(got) == 3000


def test_walks_of_hot_groups(spark):
    """One location, type or source that has all rows."""
    gold = spark.range(2000).select(F.col("id").alias("pos"), "id", F.lit("[DF1]").alias("interaction"), F.lit("L").alias("threat_type"), F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 3).cast("string"))).alias("panoptic_actions"), *(F.lit(None).cast("string").alias(c) for c in ("dfd_source_id", "dfd_destination_id")))
    gen = spark.range(2500).select(F.col("id").alias("gen_index"), F.lit("DF1").alias("flow_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b1").alias("panoptic_action"))
    flows = spark.createDataFrame([("DF1", "a", "b", 1)], "id string, source string, destination string, pos int")
    got = sorted(tuple(r) for r in matching.match_actions(gen, gold, flows).collect())
    free, want = list(range(2000)), []
    for i in range(2500):
        hit = next((g for g in free if i % 2 == 0 or g % 3 == 1), None)
        if hit is not None:
            free.remove(hit)
            want.append((i, hit))
    assert got == want
    files = spark.range(20_000).select(F.lit("s").alias("source"), F.format_string("%06d", "id").alias("f"), (F.col("id") % 97).alias("size"))
    taken = [r["f"] for r in accept.budget_fill(files, ["source"], "f", "size", 5000).where("taken").orderBy("f").collect()]
    room, want = 5000, []
    for i in range(20_000):
        if i % 97 <= room:
            room -= i % 97
            want.append(f"{i:06d}")
    assert taken == want
