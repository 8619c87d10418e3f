"""Operators on small fixtures with known results, and against plain loops on random ones."""

import json
import random

import pytest
from code_facts import FACTS, fact
from pyspark.sql import functions as F

from veriframe import boundary
from veriframe.functions import text as X
from veriframe.functions.logic import verdict
from veriframe.operators import accept, align, crosswalk, facts, matching, metrics, raster, retrieval, threats
from veriframe.operators.validate import violations
from veriframe.plans.evaluation import evaluate, evaluate_actions
from veriframe.sources import corpus, dfd, runs
from veriframe.streaming import incremental
from veriframe.tables import DFD, FACT, GOLD, THREAT_TYPES, invalid_pairs, mapping

GOLD_ROWS = [(1, "a [DF1]", "Dd", "Dd.1.1"), (2, "b [DF1]", "L", "L.1.1"), (3, "c [DF2]", "Dd", "Dd.3.4")]
GEN_ROWS = [("DF1", "Dd", "Dd.1.1"), ("DF1", "U", "U.1.1"), ("DF2", "Dd", "Dd.9.9")]


def gold_table(spark, rows):
    return spark.createDataFrame([(i, p, t, k, n, None, None) for p, (i, t, k, n) in enumerate(rows)], "id int, pos int, interaction string, threat_type string, tree_node string, dfd_source_id string, dfd_destination_id string")


def gen_table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "gen_index int, flow_id string, threat_type string, tree_node string")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("r")).first()["r"]


# matching


def test_match_counts_and_categories(spark):
    gold, gen = gold_table(spark, GOLD_ROWS), gen_table(spark, GEN_ROWS)
    pairs = matching.match(gen, gold)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (2, 3)}
    assert {tuple(r) for r in matching.match(gen, gold, strict=True).collect()} == {(0, 1)}
    by = {r["category"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.by_type(gen, gold, pairs).collect()}
    assert by == {"L": (0, 0, 1), "I": (0, 0, 0), "Nr": (0, 0, 0), "D": (0, 0, 0), "Dd": (2, 0, 0), "U": (0, 1, 0), "Nc": (0, 0, 0), "ALL": (2, 1, 1)}
    nodes = {r["category"]: r["tp"] for r in metrics.by_node(gen, gold, pairs).collect()}
    assert nodes["Dd.9.9"] == 1 and "Dd.3.4" not in nodes
    assert [r["gen_index"] for r in matching.unmatched(gen, pairs).collect()] == [1]


def test_types_outside_the_domain_vanish_from_the_total(spark):
    gold, gen = gold_table(spark, GOLD_ROWS), gen_table(spark, [*GEN_ROWS, ("DF1", "Uc", "Uc.1")])
    total = {r["category"]: r["fp"] for r in metrics.by_type(gen, gold, matching.match(gen, gold)).collect()}
    assert total["ALL"] == 1


def greedy(gen, gold, fits):
    used, out = set(), {}
    for i, g in enumerate(gen):
        for j, t in enumerate(gold):
            if j not in used and fits(g, t):
                used.add(j)
                out[i] = j
                break
    return out


def test_match_is_the_greedy_loop(spark):
    r = random.Random(1)
    gen = [(f"DF{r.randrange(6)}", r.choice("LID"), "n") for _ in range(200)]
    gold = [(i, f"x [DF{r.randrange(6)}]" if r.random() < 0.9 else "none", r.choice("LID"), "n") for i in range(150)]
    want = greedy(gen, gold, lambda g, t: g[1] == t[2] and t[1] == f"x [{g[0]}]")
    got = {r["gen_index"]: r["gold_id"] for r in matching.match(gen_table(spark, gen), gold_table(spark, gold)).collect()}
    assert got == want


def test_action_match_is_the_greedy_loop(spark):
    r = random.Random(2)
    actions = [f"PA{n:02d}.01" for n in range(1, 6)]
    flows = spark.createDataFrame([(f"DF{i}", i, "a", "b") for i in range(5)], "id string, pos int, source string, destination string")
    gen = [(i, f"DF{r.randrange(7)}", r.choice([*actions, "", None])) for i in range(120)]
    gold = [(i, i, f"[DF{r.randrange(6)}]" if r.random() < 0.9 else None, r.sample(actions, r.randrange(4))) for i in range(100)]
    g = spark.createDataFrame(gold, "id int, pos int, interaction string, panoptic_actions array<string>").withColumns({c: F.lit(None).cast("string") for c in ("dfd_source_id", "dfd_destination_id")})
    n = spark.createDataFrame(gen, "gen_index int, flow_id string, panoptic_action string")
    want = greedy(gen, gold, lambda a, t: bool(a[2]) and a[2] in t[3] and t[2] == f"[{a[1]}]" and int(a[1][2:]) < 5)
    assert {r["gen_index"]: r["gold_id"] for r in matching.match_actions(n, g, flows).collect()} == want


def test_parents_of_actions(spark):
    gold = spark.createDataFrame([(1, 0, "[DF1]", ["PA03.09", "PA08.01.01"]), (2, 1, "[DF1]", ["PA10.01"])], "id int, pos int, interaction string, panoptic_actions array<string>").withColumns({c: F.lit(None).cast("string") for c in ("dfd_source_id", "dfd_destination_id")})
    gen = spark.createDataFrame([(0, "DF1", "PA03.09"), (1, "DF1", "PA01.01"), (2, "DF1", None)], "gen_index int, flow_id string, panoptic_action string")
    flows = spark.createDataFrame([("DF1", 0, "a", "b")], "id string, pos int, source string, destination string")
    pairs = matching.match_actions(gen, gold, flows)
    by = {r["category"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.by_parent(gen, gold, pairs).collect()}
    assert by == {"PA03": (1, 0, 0), "PA01": (0, 1, 0), "PA10": (0, 0, 1)}


def test_locations_resolve_to_the_first_parallel_flow(spark):
    flows = spark.createDataFrame([("F1", 0, "A", "B"), ("F2", 1, "A", "B"), ("F3", 2, "B", "A")], "id string, pos int, source string, destination string")
    gold = spark.createDataFrame([(1, 0, None, "A", "B"), (2, 1, None, "B", "C"), (3, 2, None, None, "A")], "id int, pos int, interaction string, dfd_source_id string, dfd_destination_id string")
    assert {r["id"]: (r["flow"], r["convention"]) for r in matching.located(gold, flows).collect()} == {1: ("F1", "location_anchored"), 2: (None, "location_anchored"), 3: (None, "location_anchored")}


def test_endpoints_reanchoring_and_positions(spark):
    el = spark.createDataFrame([("P1", "Auth", 0), ("P2", "Store", 1)], "id string, name string, pos int")
    got = matching.endpoint(spark.createDataFrame([("P1 Anything",), ("Store",), ("Nobody",)], "label string"), el)
    assert {(r["label"], r["element"], r["how"]) for r in got.collect()} == {("P1 Anything", "P1", "by id"), ("Store", "P2", "by name"), ("Nobody", None, "unresolved")}
    gold = spark.createDataFrame([(1, "x [DF1]", "E1"), (2, "y [DF9]", "E9"), (3, "z", "DF1")], "id int, interaction string, originator_id string")
    e = spark.createDataFrame([("E1", "Q2"), ("E1", "Q1")], "hand_id string, derived_id string")
    f = spark.createDataFrame([("DF1", "G1")], "hand_id string, derived_id string")
    out = {r["id"]: r for r in matching.reanchored(gold, e, f).collect()}
    assert (out[1]["originator_id"], out[1]["interaction"], out[1]["remap_note"]) == ("Q1", "x [G1]", None)
    assert out[2]["interaction"] == "y" and "E9" in out[2]["remap_note"] and out[3]["originator_id"] == "G1"
    flows = spark.createDataFrame([("DF1", "S1", "D1", 0)], "id string, source string, destination string, pos int")
    g = spark.createDataFrame([(i, "[DF1]", o) for i, o in enumerate(["S1", "D1", "DF1", "X"])], "id int, interaction string, originator_id string")
    assert [r["position"] for r in matching.positions(g, flows).orderBy("id").collect()] == ["S", "D", "fl", None]
    findings = spark.createDataFrame([(0, "L", ["DF1", "DF2"]), (1, "L", ["DF2"]), (2, "L", [])], "gen_index int, threat_type string, flow_ids array<string>")
    g = gold_table(spark, [(1, "[DF2]", "L", "n"), (2, "[DF1]", "L", "n")])
    assert {tuple(r) for r in matching.match_sets(findings, g).collect()} == {(0, 1)}


# metrics


def test_human_corrected_precision(spark):
    rows = spark.createDataFrame([(x,) for x in ["spurious", "spurious", "valid_uncatalogued", "borderline", *[None] * 6]], "label string")
    r = rows.agg(*metrics.human_corrected(F.lit(5), F.lit(10))).first()
    assert r["precision_raw"] == pytest.approx(5 / 15) and r["precision_corrected"] == pytest.approx(8.75 / 15) and r["is_full_review"] is False
    none = rows.where("label is null").agg(*metrics.human_corrected(F.lit(5), F.lit(10))).first()
    assert none["precision_raw"] is None and none["precision_corrected"] is None


def test_rates_of_checks_that_ran(spark):
    c = spark.createDataFrame([(True, True, True, True), (True, True, True, False), (True, True, True, None)], "node_valid boolean, type_applicable boolean, location_valid boolean, position_applicable boolean")
    r = metrics.citation_rates(c).first()
    assert (r["position_applicable_rate"], r["n_position_cited"], r["all_valid_rate"]) == (0.5, 2, pytest.approx(2 / 3))
    assert metrics.citation_rates(c.withColumn("position_applicable", F.lit(None).cast("boolean"))).first()["position_applicable_rate"] is None
    empty = metrics.citation_rates(c.limit(0)).first()
    assert (empty["node_valid_rate"], empty["n"]) == (0.0, 0) and metrics.gold_free_rates(c.limit(0)).first()["node_valid_rate"] is None


@pytest.mark.parametrize(("checks", "want"), [((True, None), True), ((None, None), None), ((False, None), False), ((True, True), True), ((True, False), False)])
def test_an_unrun_check_is_no_pass(spark, checks, want):
    df = spark.createDataFrame([checks], "a boolean, b boolean")
    assert df.select(verdict(F.col("a"), F.col("b")).alias("v")).first()["v"] is want


def test_breakdown_recall(spark):
    rows = spark.createDataFrame([(c,) for c, n in (("matched", 7), ("reachable_but_missed", 3), ("structurally_unreachable", 5), ("unresolved_location", 2)) for _ in range(n)], "class string")
    assert threats.breakdown(rows).first()["reachable_recall"] == pytest.approx(0.7)


def test_statistics_of_one_run_have_no_deviation(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in metrics.run_stats(rows, ["k"], "v").collect()}
    assert got["a"]["sd"] is None and got["b"]["sd"] == 0.7071 and got["b"]["n"] == 2 and got["b"]["values"] == [1.0, 2.0]


# retrieval


def weights(spark, texts, **k):
    df = retrieval.bm25_postings(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), **k)
    return {(r["term"], r["doc_id"]): r["weight"] for r in df.collect()}


def test_rare_terms_weigh_more(spark):
    docs = spark.createDataFrame([(0, "alpha data"), *((i, "beta data") for i in range(1, 20))], "doc_id int, text string")
    idf = {r["term"]: r["idf"] for r in retrieval.bm25_statistics(docs).collect()}
    assert idf["alpha"] > idf["data"] >= 0 and idf["data"] < 0.1


def test_term_frequency_saturates(spark):
    pad = " ".join(f"w{i}" for i in range(40))
    w = weights(spark, ["alpha " * 5 + pad, "alpha " * 50 + pad, "other"], b=0.0)
    assert 1 < w["alpha", 1] / w["alpha", 0] < 2


def test_length_counts_only_with_b(spark):
    texts = ["alpha", "alpha " + " ".join(f"f{i}" for i in range(60)), "other"]
    flat, tilted = weights(spark, texts, b=0.0), weights(spark, texts, b=0.75)
    assert flat["alpha", 0] == pytest.approx(flat["alpha", 1]) and tilted["alpha", 0] > tilted["alpha", 1]


def test_queries_count_terms_once_and_lists_are_full(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 3 else "gamma") for i in range(9)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha"), (3, "nothing here"), (4, "")], "query_id int, query string")
    got = {}
    for r in retrieval.Index.build(docs).search(q, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert sorted(got[1]) == sorted(got[2]) and all(len(v) == 4 for v in got.values())
    assert sorted(got[3]) == [(i + 1, i, 0.0) for i in range(4)] and sorted(got[1])[0][1] == 3
    assert retrieval.Index.build(docs).search(q, k=0).where("query_id = 1").count() == 5


def test_filters_see_null_kinds(spark):
    df = spark.createDataFrame([(1, "s", None), (2, "s", "a"), (3, "t", "b")], "i int, source string, kind string")
    ids = lambda *a: [r["i"] for r in df.where(retrieval.keep(*a)).orderBy("i").collect()]
    assert ids("s") == [1, 2] and ids(None, ["a"]) == [1, 3] and ids(None, [None]) == [2, 3] and ids("s", [None, "a"]) == []


def test_index_is_rebuilt_when_it_does_not_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "beta")], "query_id int, query string")
    for backend in ("bm25", "tfidf"):
        retrieval.Index.load(spark, str(tmp_path), docs, backend)
        again = retrieval.Index.load(spark, str(tmp_path), docs, backend)
        assert again.postings is not None and again.search(q, 1).first()["doc_id"] == 2
        more = docs.union(spark.createDataFrame([(3, "beta beta gamma")], "doc_id int, text string"))
        assert retrieval.Index.load(spark, str(tmp_path), more, backend).search(q, 3).count() == 3
    with pytest.raises(ValueError):
        retrieval.Index.build(docs, "none")


# text


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.tokens(F.lit("see node Dd.1.1 for D.1")), ["see", "node", "Dd.1.1", "for", "D", "1"]),
        (lambda: X.tokens(F.lit("Étion")), ["tion"]),
        (lambda: X.flow_id(F.lit("P3 [DF7/DF10]")), None),
        (lambda: X.flow_id(F.lit("EE1 [F1]")), "F1"),
        (lambda: X.slug(F.lit("anthropic/Model 5.1!")), "anthropic-model-5-1"),
        (lambda: X.slug(F.lit(None).cast("string")), "none"),
        (lambda: X.parent_category(F.lit("PA03.09")), "PA03"),
        (lambda: X.parent_category(F.lit("x")), "?"),
        (lambda: X.canonical_path(F.lit("/a/:id/${x}/")), "/a/{p}/{p}"),
        (lambda: X.url_base(F.lit("http://h:5000/api/")), "/api"),
        (lambda: X.resolve_path(F.lit("@dirname/../uploads/./images"), F.lit("backend/middleware/u.js")), "backend/uploads/images"),
        (lambda: X.resolve_path(F.lit(""), F.lit("a/b")), None),
        (lambda: X.path_prefix(F.lit("backend/uploads/images"), F.lit("backend/uploads")), True),
        (lambda: X.path_prefix(F.lit("backend/uploads_public"), F.lit("backend/uploads")), False),
        (lambda: X.node_id(F.lit("DD.1.2")), "Dd.1.2"),
        (lambda: X.comma_list(F.lit(" a, ,b ")), ["a", "b"]),
        (lambda: X.heading(F.lit("## A b ")), "A b"),
        (lambda: X.title_of(F.lit("one two three four"), 10), "one two…"),
        (lambda: X.retry_after(F.lit("Please try again in 300ms."), F.lit(None).cast("string")), 0.3),
        (lambda: X.retry_after(F.lit("no"), F.lit("120")), 65.0),
        (lambda: X.dotted_prefixes(F.lit("a.b.c")), ["a.b.c", "a.b", "a"]),
        (lambda: X.ngram_terms(F.lit("A big Dog, the dog x"), ("the",)), ["big", "dog", "dog", "big dog", "dog dog"]),
    ],
)
def test_text_functions(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(("name", "want"), [("User", "users"), ("ChildProfile", "childprofiles"), ("Child", "childs"), ("News", "news"), ("Policy", "policies"), ("Box", "boxes"), ("Analysis", "analyses"), ("Mouse", "mice"), ("Wife", "wives"), ("Status", "statuses"), ("Children", "children"), ("Matrix", "matrices")])
def test_plurals(spark, name, want):
    assert one(spark, X.pluralize(F.lit(name))["collection"]) == want


def test_fact_ids_digest_sorted_json(spark):
    import hashlib

    fields = {"b": 'x"y', "a": "ü"}
    text = json.dumps(fields, sort_keys=True, ensure_ascii=False)
    want = "F" + hashlib.sha256(f"c|f.js|3|{text}".encode()).hexdigest()[:8]
    assert one(spark, X.fact_id(F.lit("c"), F.lit("f.js"), F.lit(3), X.json_object(F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit("ü"))))) == want


def test_labels_of_items(spark):
    got = one(spark, X.label_items(F.lit("Medical app: reads data. Smart lock: opens. and more")))
    assert [tuple(x) for x in got] == [("Medical app", "reads data."), ("Smart lock", "opens. and more")]


# corpus


@pytest.mark.parametrize(("n", "want"), [(0, 1), (1, 1), (700, 1), (701, 2), (1200, 2), (1201, 3), (1300, 3), (1301, 3)])
def test_number_of_pieces(spark, n, want):
    assert len(one(spark, corpus.pieces(F.lit("é" * n)))) == want


def test_sections_and_corpus(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "sc" / "x_derived").mkdir(parents=True)
    (tmp_path / "kb" / "a.md").write_text("intro\n# One\nbody one\n### not a section\n\n## Two \n" + "x" * 1300)
    (tmp_path / "kb" / "t.json").write_text(json.dumps({"threat_types": {"L": {"name": "Linking", "definition": "d", "nodes": {"L.1": {"title": "T", "description": "D"}}}}}))
    (tmp_path / "kb" / "m.json").write_text(json.dumps({"interactions": [{"source": "Process", "destination": "DataStore", "applicable_threats": {"L": ["S", "D"]}}], "invalid_interactions": [{"source": "DataStore", "destination": "DataStore", "reason": "no"}]}))
    (tmp_path / "kb" / "r.json").write_text('{"other": 1}')
    (tmp_path / "sc" / "gold.json").write_text(json.dumps({"threats": [{"id": 7, "title": "t", "threat_type": "L", "tree_node": "L.1", "originator_id": "P1", "dfd_source_id": "A", "description": "d", "assumptions": "a", "severity": "s", "likelihood": "l"}]}))
    (tmp_path / "sc" / "dfd.json").write_text("{}")
    (tmp_path / "sc" / "x_derived" / "gold.json").write_text('{"threats": []}')
    got = corpus.corpus(spark, {"linddun": str(tmp_path / "kb"), "scenarios": str(tmp_path / "sc")}).collect()
    by = {r["id"]: r for r in got}
    assert by["linddun:a.md:0"]["section"] == "" and by["linddun:a.md:1"]["text"] == "body one\n### not a section"
    assert [len(by[f"linddun:a.md:{i}"]["text"]) for i in (2, 3, 4)] == [700, 700, 100] and by["linddun:a.md:2"]["section"] == "Two"
    assert by["linddun:t.json:1"]["text"] == "Threat tree node L.1 — T: D (LINDDUN type: Linking)" and by["linddun:t.json:1"]["meta"]["tree_node"] == "L.1"
    assert by["linddun:m.json:0"]["text"].endswith("positions: L at S/D.") and by["linddun:m.json:1"]["meta"]["kind"] == "mapping_invalid"
    assert by["linddun:r.json:0"]["meta"]["kind"] == "raw_json"
    assert "interaction A->?" in by["scenarios:gold.json:0"]["text"] and by["scenarios:gold.json:0"]["meta"]["threat_id"] == 7
    assert not any("derived" in i or "dfd" in i for i in by)
    stats = {(r["by"], r["value"]): r["count"] for r in corpus.corpus_stats(spark.createDataFrame([(r["source"], (r["meta"]["kind"] if r["meta"] else None,)) for r in got], "source string, meta struct<kind:string>")).collect()}
    assert stats["kind", "prose"] == 5 and stats["source", "scenarios"] == 1


def test_source_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("1")
    (tmp_path / "a.js").write_text("1\n2\n")
    (tmp_path / "b.py").write_text("1\n2")
    (tmp_path / "c.txt").write_text("1")
    assert {r["doc"]: r["n_lines"] for r in corpus.source_files(spark, str(tmp_path)).collect()} == {"a.js": 2, "b.py": 2}


# diagrams


def diagram(spark, **change):
    base = {"_meta": {"scenario": "s", "schema_version": 2}, "elements": [{"id": "EE1", "type": "ExternalEntity", "name": "U"}, {"id": "P1", "type": "Process", "name": "P"}], "flows": [{"id": "DF1", "source": "EE1", "destination": "P1", "description": "d"}], "trust_boundaries": [{"id": "T1", "name": "t", "contains": ["P1"]}]}
    base |= change
    return spark.read.schema(f"dfd_id string, {DFD}").json(spark.sparkContext.parallelize([json.dumps({"dfd_id": "a"} | base)]))


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        (None, {}),
        ("V-2", {"_meta": {"schema_version": 3}}),
        ("V-4", {"elements": [{"id": "EE1", "type": "Process", "name": "a"}, {"id": "P1", "type": "Process", "name": "P"}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-5", {"elements": [{"id": "EE1", "type": "Cloud", "name": "a"}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-6", {"elements": [{"id": "EE1", "type": "Process", "name": ""}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-7", {"elements": [{"id": "EE1", "type": "Process", "name": "a", "provenance": [{"fact_id": "F1", "file": "f", "line": 1}]}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-7", {"elements": [{"id": "EE1", "type": "Process", "name": "a", "provenance": [{"label_text": "x"}]}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-7", {"elements": [{"id": "EE1", "type": "Process", "name": "a", "provenance": [{"bbox": [1, 2, 3]}]}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-8", {"flows": [{"id": "DF1", "source": "EE1", "destination": "P1", "description": "d"}] * 2}),
        ("V-9", {"flows": [{"id": "DF1", "source": "EE1", "destination": "P9", "description": "d"}]}),
        ("V-9", {"flows": [{"id": "DF1", "source": "EE1", "description": "d"}]}),
        ("V-10", {"flows": [{"id": "DF1", "source": "EE1", "destination": "P1"}]}),
        ("V-11", {"trust_boundaries": [{"id": "T1", "name": ""}]}),
        ("V-12", {"trust_boundaries": [{"id": "T1", "name": "t", "contains": ["X"]}]}),
        ("V-13", {"elements": [{"id": "EE1", "type": "Process", "name": "a", "trust_boundary": "T9"}, {"id": "P1", "type": "Process", "name": "P"}]}),
        ("V-14", {"flows": [{"id": "DF1", "source": "EE1", "destination": "P1", "description": "d", "crosses_boundaries": ["T9"]}]}),
    ],
)
def test_one_violation_each(spark, rule, change):
    assert [r["rule"] for r in violations(diagram(spark, **change)).collect()] == ([rule] if rule else [])


def test_files_of_a_scenario(spark, tmp_path):
    good = diagram(spark)
    with pytest.raises(ValueError, match="derived"):
        dfd.emit(good, str(tmp_path / "hand"))
    with pytest.raises(ValueError, match="V-9"):
        dfd.emit(diagram(spark, flows=[{"id": "DF1", "source": "EE1", "destination": "P9", "description": "d"}]), str(tmp_path / "a_derived"))
    dfd.emit(good, str(tmp_path / "a_derived"))
    back = spark.read.schema(DFD).json(str(tmp_path / "a_derived")).first()
    assert back["_meta"]["schema_version"] == 2 and back["flows"][0]["id"] == "DF1"
    (tmp_path / "d.json").write_text(json.dumps({"elements": [{"id": "P1", "type": "Process", "name": "n"}], "flows": []}, indent=1))
    assert dfd.elements_of(dfd.read_dfds(spark, str(tmp_path / "d.json"))).first()["id"] == "P1"
    for text in ('{"threats": [{"id": 1, "threat_type": "L", "extra": 5}]}', '[{"id": 1, "threat_type": "L"}]'):
        (tmp_path / "g.json").write_text(text)
        assert [(r["pos"], r["id"], r["threat_type"]) for r in dfd.read_gold(spark, str(tmp_path / "g.json")).collect()] == [(0, 1, "L")]
    (tmp_path / "k.json").write_text('{"elements": {"P1": {"kind": "route_mount", "key": "/a"}, "EE9": {"kind": "none", "implemented": false}}}')
    assert {(r["element_id"], r["kind"], r["key"], r["implemented"]) for r in dfd.read_hand_keys(spark, str(tmp_path / "k.json")).collect()} == {("P1", "route_mount", "/a", True), ("EE9", "none", "", False)}
    (tmp_path / "e.json").write_text('{"elements": {}}')
    with pytest.raises(ValueError):
        dfd.read_hand_keys(spark, str(tmp_path / "e.json"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dfd.read_hand_keys(spark, str(tmp_path / "missing.json"))
    (tmp_path / "t.json").write_text('{"privacy_activities": [{"id": "PA01", "name": "n", "sub_activities": [{"id": "PA01.01", "name": "s"}]}]}')
    assert {(r["id"], r["parent"], tuple(r["linddun_types"])) for r in dfd.taxonomy(spark, str(tmp_path / "t.json")).collect()} == {("PA01", None, ()), ("PA01.01", "PA01", ())}
    (tmp_path / "x.json").write_text('[{"edge": {"from": "A", "to": "B"}, "category": "Linking", "source_id": "L.1"}]')
    assert dfd.third_party(spark, str(tmp_path / "x.json")).first()["nodes"] == ["L.1", None, None]
    (tmp_path / ".env").write_text("VF_A=1\nVF_B=\n# c\n")
    assert dfd.settings(str(tmp_path / ".env")).get("VF_A") == "1" and "VF_B" not in dfd.settings(str(tmp_path / ".env"))
    assert dfd.code_version(str(tmp_path)) == "unknown"


def test_evaluation_plan(spark):
    el = spark.createDataFrame([("EE1", "User", "ExternalEntity"), ("P1", "App", "Process"), ("DS1", "Db", "DataStore")], "id string, name string, type string")
    fl = spark.createDataFrame([("DF1", 0, "EE1", "P1", "asks"), ("DF2", 1, "P1", "DS1", "writes"), ("DF3", 2, "DS1", "DS1", "copies")], "id string, pos int, source string, destination string, description string")
    nodes = spark.createDataFrame([("Dd", "Dd.1.1"), ("L", "L.1.1")], "threat_type string, node_id string")
    gold = gold_table(spark, [*GOLD_ROWS, (4, "d [DF3]", "L", "L.1.1"), (5, "nowhere", "L", "L.1.1")])
    gen = gen_table(spark, GEN_ROWS).withColumn("originator_id", F.lit("EE1")).withColumn("position", F.when(F.col("gen_index") == 0, "S").when(F.col("gen_index") == 2, "D"))
    e = evaluate(spark, gen, gold, el, fl, nodes)
    r = e.reach.first()
    assert (r["matched"], r["reachable_but_missed"], r["structurally_unreachable"], r["unresolved_location"]) == (2, 1, 1, 1)
    c = e.citations.first()
    assert (c["node_valid_rate"], c["location_valid_rate"], c["n_position_cited"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 2)
    assert {x["category"] for x in e.scores.collect()} == {*THREAT_TYPES, "ALL"} and e.nodes.count() == 4
    checked = {x["gen_index"]: x for x in threats.verified(gen, el, fl, nodes, mapping(spark), invalid_pairs(spark)).collect()}
    assert checked[1]["position_applicable"] is None and checked[0]["reasons"] == [] and len(checked[2]["reasons"]) == 2
    a = evaluate_actions(spark, gen.withColumn("panoptic_action", F.lit("PA01.02")), gold.withColumn("panoptic_actions", F.array(F.lit("PA01.02"))), el, fl, nodes)
    assert a.reach.first()["structurally_unreachable"] == 0 and a.pairs.count() == 3
    asks = threats.with_endpoints(fl, el).withColumn("q", threats.flow_query())
    assert asks.where("id = 'DF1'").first()["q"] == "User -> App: asks"
    valid, skipped = threats.gated(threats.with_endpoints(fl, el), mapping(spark), invalid_pairs(spark))
    assert valid.count() == 2 and skipped.first()["note"].startswith("data stores")
    p = threats.prompts(threats.with_endpoints(fl, el), spark.createDataFrame([("DF1", 2, "second"), ("DF1", 1, "first")], "flow string, pos int, block string"), "Do this.")
    text = p.where("flow = 'DF1'").first()
    assert text["prompt"].endswith("first\nsecond") and text["prompt_chars"] == len(text["prompt"])
    with pytest.raises(ValueError):
        threats.chosen_flows(fl, ["DF1", "DF9"])
    assert threats.mode(rag=True) == "rag" and threats.mode(framework="panoptic") == "panoptic"
    with pytest.raises(ValueError):
        threats.mode(True, True)
    ok, bad = threats.well_formed(spark.createDataFrame([(1, "a"), (2, None)], "i int, x string"), ["i", "x"])
    assert ok.count() == 1 and bad.first()["malformed"] == 1
    assert threats.known_fields(spark.createDataFrame([(0, "DF1", True, 5)], "gen_index int, flow_id string, grounded boolean, odd int").withColumn("mode", F.lit(None).cast("string"))).first().asDict() == {"gen_index": 0, "flow_id": "DF1", "grounded": True, "mode": "grounded"}


# facts


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame(FACTS, FACT).cache()


def test_facts_across_files(code):
    out = facts.resolved(code).where("derived").collect()
    by = {}
    for r in out:
        by.setdefault(r["construct"], []).append(r["fields"])
    assert {(f["model_name"], f["collection"], f["resolved_via"]) for f in by["mongo_collection"]} == {("User", "users", "pluralization_rule"), ("Video", "clips", "schema_option")}
    assert {(f["from_fact_id"], f["collection"]) for f in by["db_access"]} == {("F12", "users"), ("F13", "clips")}
    assert [f["fs_path"] for f in by["fs_location"]] == ["uploads"]
    assert {(f["from_fact_id"], f["route_fact_id"], f["absolute_path"]) for f in by["http_route_binding"]} == {("F19", "F03", "/api/videos/approved"), ("F20", "F04", "/api/videos/{p}")}


def test_diagram_from_facts(spark, code):
    # each step is written before the next reads it, as a diagram is
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    all_of = fixed(facts.resolved(code))
    el = {r["id"]: (r["type"], r["key"], r["fact_ids"]) for r in facts.elements(all_of).collect()}
    assert {k: v[1] for k, v in el.items()} == {"EE1": "child", "EE2": "parent", "P1": "/api/users", "P2": "/api/videos", "DS1": "clips", "DS2": "users", "DS3": "uploads", "DS4": "localStorage"}
    assert el["P2"][2] == ["F01", "F03", "F04"]
    parts = fixed(facts.elements(all_of))
    drawn = fixed(facts.implied_flows(all_of, parts))
    fl = [(r["source"], r["destination"], r["intent"]) for r in drawn.collect()]
    assert set(fl) == {("EE2", "P2", "request"), ("P2", "EE2", "response"), ("EE1", "P2", "request"), ("P2", "EE1", "response"), ("P1", "DS2", "db_write"), ("DS1", "P2", "db_read"), ("P2", "DS3", "file_write")}
    cite = F.transform("fact_ids", lambda x: F.struct(x.alias("fact_id"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")))
    items = parts.select("id", "type", "name", cite.alias("provenance"))
    keys = {r["item"]: (r["kind"], r["key"]) for r in align.element_keys(items, all_of).collect()}
    assert keys["P2"] == ("route_mount", "/api/videos") and keys["DS3"] == ("fs_path", "uploads") and keys["EE1"][0] == "actor_role"
    flows = drawn.select("id", "source", "destination", cite.alias("provenance"))
    links = accept.evidence_links(flows, items, all_of).collect()
    assert all(r["endpoints_declared"] and r["evidence_connects"] for r in links)
    ok = accept.verify_items(items, all_of).collect()
    assert all(r["citations_resolvable"] and r["evidence_type_consistent"] and r["facts_present"] is None and r["all_valid"] for r in ok)
    strong = accept.verify_items(items, all_of, all_of.where("id <> 'F04'"), spark.createDataFrame([("server.js", 50)], "doc string, n_lines int")).collect()
    assert {r["id"] for r in strong if r["facts_present"] is False} == {"P2"}
    assert "DERIVED" in facts.rendered(all_of).where("text like '%mongo_collection%'").first()["text"]
    assert accept.upload_targets(all_of).first()["fs_path"] == "uploads"


def test_open_citations(spark, code):
    p = "array<struct<fact_id:string,file:string,line:int>>"
    items = spark.createDataFrame([("P1", "Process", [(None, "server.js", 10)]), ("P2", "Process", [(None, "server.js", 99)]), ("P3", "Process", [("F99", None, None)]), ("P4", "Process", [])], f"id string, type string, provenance {p}")
    blind = {r["id"]: r["all_valid"] for r in accept.verify_items(items, code).collect()}
    assert blind == {"P1": None, "P2": None, "P3": False, "P4": False}
    seen = {r["id"]: r for r in accept.verify_items(items, code, code, spark.createDataFrame([("server.js", 50)], "doc string, n_lines int")).collect()}
    assert seen["P1"]["all_valid"] is True and seen["P2"]["citations_resolvable"] is False and seen["P2"]["facts_present"] is False


def test_first_route_wins(spark):
    r = random.Random(4)
    seg = lambda: r.choice(["a", "b", ":x"])
    table = [(f"r{i}", r.choice(["GET", "POST"]), f"f{r.randrange(3)}", "/", "/" + "/".join(seg() for _ in range(r.randrange(1, 4))), i) for i in range(40)]
    calls = [(i, r.choice(["get", "post"]), "/" + "/".join(r.choice("abc") for _ in range(r.randrange(1, 4)))) for i in range(80)]
    want = {}
    for i, m, p in calls:
        w = p.strip("/").split("/")
        fit = [(f, n, k) for k, mm, f, _, full, n in table if mm == m.upper() and len(h := full.strip("/").split("/")) == len(w) and all(x[0] == ":" or x == y for x, y in zip(h, w))]
        want[i] = min(fit)[2] if fit else None
    got = facts.dispatched(spark.createDataFrame(calls, "i int, method string, path string"), spark.createDataFrame(table, "id string, method string, file string, mount_path string, full_path string, line int"), "i")
    assert {x["i"]: x["route_id"] for x in got.collect()} == want


def test_innermost_span(spark):
    r = random.Random(5)
    spans = [(f"f{r.randrange(3)}", f"s{i}", a, a + r.choice([3, 50, 900, 40_000, 3_000_000])) for i in range(150) for a in [r.randrange(100_000)]]
    points = [(i, f"f{r.randrange(3)}", r.randrange(120_000)) for i in range(300)]
    want = {i: min(((b - a, a, s) for g, s, a, b in spans if g == f and a <= at <= b), default=(0, 0, None))[2] for i, f, at in points}
    got = facts.enclosing(spark.createDataFrame(points, "p int, file string, line int"), spark.createDataFrame(spans, "file string, id string, line int, end_line int"), "p")
    assert {x["p"]: x["span_id"] for x in got.collect()} == want


def test_base_paths_must_agree(spark, code):
    assert tuple(facts.base_path(code).first()) == ("/api", "high")
    two = spark.createDataFrame([fact("F1", "http_client_config", "c.js", 1, base_url_branches=["http://a/x", "http://a/y"])], FACT)
    assert tuple(facts.base_path(two).first()) == ("", "low") and tuple(facts.base_path(two.limit(0)).first()) == ("", "low")


def test_ranking_and_reconciliation(spark):
    rows = spark.createDataFrame([(1, "Plausible", "Moderate", "L", 0.42)], "id int, feasibility string, difficulty string, threat_type string, ranking_value double")
    combos = spark.createDataFrame([("Plausible", "Moderate", 0.6)], "feasibility string, difficulty string, combo double")
    out = facts.ranking(rows, combos, spark.createDataFrame([("L", 0.7)], "threat_type string, weight double"))
    assert out.first()["computed"] == 0.42
    b = spark.createDataFrame([(1, "Plausible", 0.4249), (2, "x", 1.0)], "id int, feasibility string, ranking_value double")
    assert facts.reconciled(rows, b, "id", ["feasibility"], "ranking_value").first()["issues"] == []
    assert facts.reconciled(rows, b.withColumn("ranking_value", F.lit(0.43)), "id", ["feasibility"], "ranking_value").first()["issues"] == ["ranking_value differs"]


# alignment


def test_elements_align_by_key(spark):
    d = spark.createDataFrame([("D1", "mongo_collection", "users"), ("D2", "mongo_collection", "users"), ("D3", "fs_path", "backend/uploads/images"), ("D4", "fs_path", "backend/uploads"), ("D5", "fs_path", "backend/uploads_public")], "item string, kind string, key string")
    h = spark.createDataFrame([("H1", "mongo_collection", "users", True), ("H2", "fs_path", "/backend/uploads/", True), ("H3", "none", "", False), ("H4", "none", "", True)], "element_id string, kind string, key string, implemented boolean")
    pairs = align.align_elements(d, h)
    assert {tuple(r) for r in pairs.collect()} == {("D1", "H1"), ("D3", "H2"), ("D4", "H2")}
    r = align.element_derivability(h, pairs).first()
    assert (r["matched"], r["structurally_underivable"], r["unresolved_key"], r["raw_recall"], r["derivable_recall"]) == (2, 1, 1, 0.5, 1.0)


def loop_align(derived, hand):
    """One pair of end points with several hand flows, as the rule says it."""
    tok = lambda s: {t for t in s.split() if len(t) > 1}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    scored = sorted(((jac(tok(ht), tok(dt)), h, d) for h, ht in hand for d, dt in derived), key=lambda x: (-x[0], x[1], x[2]))
    th, td, out = set(), set(), {}
    for _, h, d in scored:
        if h not in th and d not in td:
            th.add(h)
            td.add(d)
            out[d] = (h, True)
    for d, _ in derived:
        if d not in td:
            out[d] = (max((s, h) for s, h, c in scored if c == d)[1], False)
    return out


def test_ambiguous_flows_align_best_first(spark):
    r = random.Random(6)
    words = ["store", "images", "video", "user", "list", "send"]
    for _ in range(6):
        say = lambda: " ".join(r.sample(words, r.randrange(1, 4)))
        hand, derived = [(f"H{i}", say()) for i in range(r.randrange(2, 4))], [(f"D{i}", say()) for i in range(r.randrange(1, 6))]
        el = spark.createDataFrame([("s", "S"), ("t", "T")], "derived string, hand string")
        d = spark.createDataFrame([(i, "s", "t", t) for i, t in derived], "id string, source string, destination string, description string")
        h = spark.createDataFrame([(i, "S", "T", t) for i, t in hand], "id string, source string, destination string, description string")
        assert {x["derived"]: (x["hand"], x["ambiguous"]) for x in align.align_flows(d, h, el).collect()} == loop_align(derived, hand)


def test_flow_derivability_and_scores(spark):
    hand = spark.createDataFrame([("A", "x", True), ("B", "x", False), ("C", "none", True)], "element_id string, kind string, implemented boolean")
    flows = spark.createDataFrame([("F1", "A", "A"), ("F2", "A", "B"), ("F3", "A", "C"), ("F4", "A", "A")], "id string, source string, destination string")
    pairs = spark.createDataFrame([("D1", "F1", True), ("D2", "F1", False)], "derived string, hand string, ambiguous boolean")
    r = align.flow_derivability(flows, hand, pairs).first()
    assert (r["matched"], r["structurally_underivable"], r["unresolved_key"], r["derivable_but_missed"], r["derivable_recall"]) == (1, 1, 1, 1, 0.5)
    s = align.adapter_scores(flows.limit(3), flows, pairs.drop("ambiguous"), pairs).first()
    assert (s["n_elements"], s["flow_granularity"], s["n_ambiguous"], s["flow_precision_raw"]) == (3, 2.0, 1, 0.5)


# acceptance


def test_enrichments_are_accepted_with_evidence(spark):
    raw = spark.createDataFrame([(0, "DF1", "note", ["F1", "F9"]), (1, "DF7", "n", ["F1"]), (2, "DF2", "n", ["F9"]), (3, "DF1", "again", ["F1"]), (4, "DF3", " ", ["F1"])], "pos int, flow_id string, data_note string, fact_ids array<string>")
    flows = spark.createDataFrame([("DF1",), ("DF2",), ("DF3",)], "id string")
    known = spark.createDataFrame([("F1",)], "id string")
    got = {r["pos"]: (r["status"], r["reason"], r["cited_ids"]) for r in accept.accept_enrichments(raw, flows, known).collect()}
    assert got[0] == ("kept", None, ["F1"]) and [got[i][0] for i in range(1, 5)] == ["rejected"] * 4 and got[3][1] == "duplicate"
    assert sum(r["status"] == "kept" for r in accept.accept_enrichments(raw, flows).collect()) == 2


def test_elements_and_flows_are_accepted(spark):
    raw = spark.createDataFrame([(0, "P1", "Cloud", "n", ["F1"]), (1, "P1", "Process", "n", ["F9", "F1"]), (2, "P1", "Process", "n", ["F1"]), (3, "P2", "Process", "n", ["F9"]), (4, None, "Process", "n", ["F1"])], "pos int, id string, type string, name string, fact_ids array<string>")
    known = spark.createDataFrame([("F1",)], "id string")
    got = {r["pos"]: r for r in accept.accept_elements(raw, known).collect()}
    assert [got[i]["status"] for i in range(5)] == ["rejected", "kept", "rejected", "rejected", "rejected"] and "F9" in got[1]["uncertainty_note"]
    assert [r["status"] for r in accept.accept_elements(raw).orderBy("pos").collect()] == ["rejected", "kept", "rejected", "kept", "rejected"]
    flows = spark.createDataFrame([(0, "DF1", "P1", "P1", None, ["F1"]), (1, "DF2", "P1", "P9", "d", ["F1"]), (2, "DF1", "P1", "P1", "d", ["F1"])], "pos int, id string, source string, destination string, description string, fact_ids array<string>")
    f = {r["pos"]: (r["status"], r["description"]) for r in accept.accept_flows(flows, spark.createDataFrame([("P1",)], "id string"), known).collect()}
    assert f == {0: ("kept", "P1 -> P1"), 1: ("rejected", "d"), 2: ("rejected", "d")}
    c = spark.createDataFrame([([(" a ", "3"), ("", "1"), ("b", "x"), (None, "1")],)], "c array<struct<file:string,line:string>>")
    assert [tuple(x) for x in c.select(accept.clean_citations(F.col("c")).alias("c")).first()["c"]] == [("a", 3)]


def test_budget_takes_later_smaller_files(spark):
    files = spark.createDataFrame([("r", "a", 60), ("r", "b", 60), ("r", "c", 40)], "repo string, file string, size int")
    assert {r["file"]: r["taken"] for r in accept.budget_fill(files, ["repo"], "file", "size", 100).collect()} == {"a": True, "b": False, "c": True}


def test_enrichment_contract(spark):
    kind = "id string, source string, destination string, description string, provenance array<struct<fact_id:string,file:string,line:int>>, fact_ids array<string>"
    before = spark.createDataFrame([("DF1", "A", "B", "d", None, None), ("DF2", "A", "B", "d", None, None)], kind)
    el = spark.createDataFrame([("A", "n")], "id string, name string")
    known = spark.createDataFrame([("F1",)], "id string")
    fine = before.withColumn("description", F.concat("description", F.lit(" [code: x]"))).withColumn("fact_ids", F.array(F.lit("F1")))
    assert accept.enrichment_violations(before, fine, el, el, known).count() == 0
    bad = spark.createDataFrame([("DF1", "A", "C", "x", [("F1", None, None)], ["F7"]), ("DF3", "A", "B", "d", None, None)], kind)
    got = {(r["id"], r["problem"].split(" F7")[0]) for r in accept.enrichment_violations(before, bad, el, el.withColumn("name", F.lit("m")), known).collect()}
    assert got == {("elements", "elements changed"), ("DF1", "endpoints changed"), ("DF1", "original description not preserved as prefix"), ("DF1", "provenance changed"), ("DF1", "fact_id in provenance"), ("DF1", "enrichment cites unresolvable fact id"), ("DF2", "flow id set changed"), ("DF3", "flow id set changed")}
    assert accept.description_growth(before, fine).first()["n_enriched"] == 2


# taxonomies


def test_crosswalk(spark):
    f = spark.createDataFrame([("PA12", "L"), ("PA01", "I")], "a string, b string")
    b = spark.createDataFrame([("I", "PA01"), ("U", "PA12"), ("L", "PA12")], "a string, b string")
    assert [tuple(r) for r in crosswalk.asymmetries(f, b).collect()] == [("PA12", [], ["U"])]
    assert {r["a"]: r["partners"] for r in crosswalk.sides(crosswalk.both_readings(f, b), "a", "b").collect()} == {"PA12": ["L", "U"], "PA01": ["I"]}
    diff = crosswalk.node_diff(spark.createDataFrame([("L", "L.1"), ("L", "L.2")], "threat_type string, node_id string"), spark.createDataFrame([("L", "L.2"), ("L", "L.3")], "threat_type string, node_id string"))
    assert tuple(diff.first()) == ("L", ["L.3"], ["L.1"])
    rows = spark.createDataFrame([("a.b.c",), ("x",), ("o",)], "node string")
    nodes = spark.createDataFrame([("a",), ("a.b",)], "node_id string")
    o = spark.createDataFrame([("o", "a")], "node_id string, target string")
    assert {r["node"]: r["resolved"] for r in crosswalk.nearest_ancestor(rows, nodes, overrides=o).collect()} == {"a.b.c": "a.b", "x": None, "o": "a"}
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["skip", "L.1 Linked data", "A descrip-", "tion of it", "Dd.1.2 Other", "text"])], "doc string, n int, line string")
    assert {(r["node_id"], r["title"], r["body"]) for r in crosswalk.tree_lines(lines).collect()} == {("L.1", "Linked data", "A description of it"), ("Dd.1.2", "Other", "text")}


# runs


def test_reports(spark, tmp_path):
    text = "n_generated=172 n_gold=99\nALL 19 153 80 0.11 0.19 0.14\n  all_valid_rate  0.90\n  unresolved_location   {}\n"
    for i, lost in enumerate((3, 99)):
        p = tmp_path / "s" / "dfd_llm_arm_m" / f"run{i + 1}"
        p.mkdir(parents=True)
        (p / "grounded_eval.txt").write_text(text.format(lost))
    (tmp_path / "s" / "dfd_llm_arm_m" / "runx").mkdir()
    (tmp_path / "s" / "dfd_llm_arm_m" / "runx" / "grounded_eval.txt").write_text("nothing")
    got = runs.discover(runs.read_reports(spark, str(tmp_path)), str(tmp_path)).collect()
    assert {(r["run"], r["tp"], r["fp"], r["fn"], r["unscorable"], r["arm"]) for r in got} == {(1, 19, 153, 80, False, "llm_arm"), (2, 19, 153, 80, True, "llm_arm")}
    s = runs.summary(spark.createDataFrame(got), "condition").first()
    assert (s["recall_n"], s["citation_all_valid_n"], s["unscorable_runs"], s["recall_sd"]) == (1, 2, 1, None)
    assert runs.next_run(spark.createDataFrame(got), "condition").first()["next_run"] == 3
    counts = spark.createDataFrame([("ALL", 1, 1, 1), ("L", 1, 1, 1)], "category string, tp int, fp int, fn int")
    assert runs.report(metrics.scored(counts)).collect()[-1]["line"].startswith("ALL")


def test_report_writes_large_counts_whole(spark):
    counts = spark.createDataFrame([("ALL", 235362, 63798, 3_000_000_000), ("L", 1, 0, 0)], "category string, tp bigint, fp bigint, fn bigint")
    got = [r["line"].split() for r in runs.report(metrics.scored(counts)).collect()]
    assert [x[:4] for x in got] == [["L", "1", "0", "0"], ["ALL", "235362", "63798", "3000000000"]] and {len(x) for x in got} == {7}


def test_state_is_resumable(spark, tmp_path):
    state, rows = str(tmp_path / "state"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    runs.append_state(rows, state, ["k"])
    runs.append_state(rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), state, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(state).collect()) == [1, 2, 3]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(inbox)
    for _ in range(2):
        q = incremental.resumable(incremental.cells(spark, inbox, "k int, v string"), lambda b: b, out, str(tmp_path / "cp"), ["k"])
        q.awaitTermination(60)
        rows.withColumn("k", F.col("k") + 1).write.mode("append").parquet(inbox)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    have = spark.createDataFrame([(5, "spurious")], "gen_index int, label string")
    cand = spark.createDataFrame([(i,) for i in range(20)], "gen_index int")
    small, large = runs.topped_up(have, cand, 5), runs.topped_up(have, cand, 9)
    ids = lambda df: {r["gen_index"] for r in df.collect()}
    assert len(ids(small)) == 5 and ids(small) < ids(large) and large.where("label = 'spurious'").count() == 1
    assert runs.topped_up(have, cand).count() == 20
    assert runs.only_ok(spark.createDataFrame([("ok",), (None,), ("bad",)], "status string")).count() == 2


def test_streamed_windows(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = incremental.windows(stream, late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r)[:4] for r in spark.sql("select * from w").collect()} == {tuple(r)[:4] for r in incremental.windows(e).collect()}
    assert incremental.sessions(e).agg(F.sum("n")).first()[0] == e.count()


# outside


def test_boundary_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")

    def call(row):
        if row["id"] == 2:
            raise boundary.TransientError("later")
        if row["id"] == 3:
            raise KeyError("x")
        return [{"answer": row["text"].upper()}, {"answer": "2"}]

    got = {(r["id"], r["idx"], r["status"], r["answer"]) for r in boundary.answered(rows, call, "answer string", 2, retries=1).collect()}
    assert got == {(1, 0, "ok", "A"), (1, 1, "ok", "2"), (2, -1, "failed", None), (3, -1, "failed", None)}
    assert {r["status"] for r in boundary.answered(rows, boundary.no_service, "answer string", 2).collect()} == {"empty"}


def test_boxes_on_a_raster(spark):
    import numpy as np

    g = np.full((100, 200), 250, np.uint8)
    g[20:40, 40:80] = 0
    images = spark.createDataFrame([("i", 200, 100, bytearray(g.tobytes()))], "image string, width int, height int, grey binary")
    boxes = spark.createDataFrame([("i", "P1", [20, 10, 10, 5]), ("i", "P2", [180, 90, 40, 40])], "image string, item string, box array<int>")
    got = {r["item"]: r for r in raster.box_checks(boxes, images).collect()}
    assert got["P1"]["has_ink"] and got["P1"]["scale"] > 1 and not got["P2"]["in_bounds"]
    fixed = {r["item"]: r for r in raster.box_checks(boxes, images, 1.0).collect()}
    assert not fixed["P1"]["has_ink"]
    items = spark.createDataFrame([("i", "P1"), ("i", "P2"), ("i", "P3")], "image string, item string")
    assert {r["item"]: r["all_valid"] for r in raster.item_checks(items, raster.box_checks(boxes, images)).collect()} == {"P1": True, "P2": False, "P3": False}
    assert GOLD


def test_cosine_of_more_queries_than_are_broadcast(spark, monkeypatch):
    r = random.Random(6)
    vectors = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id bigint, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 3 = 0")
    found = lambda: sorted(tuple(x) for x in retrieval.cosine_top_k(vectors, queries).collect())
    few = found()
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 5)
    assert len(few) == 100 and found() == few
