"""Registered queries of the operators on code facts, diagrams' contracts, alignment and comparison, each with its SQL.

The tables stand for facts: suppliers mount routers, parts are routes, customers are models and elements, orders are flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as X
from veriframe.operators import accept, align, crosswalk, facts, matching, metrics, raster, threats
from veriframe.operators.validate import violations
from veriframe.plans import comparison
from veriframe.plans.queries import _DFD, _GG, _GREEDY, _PRF, _TYPE_SQL, _diagram, _rounded, _threats, _type_of, query
from veriframe.sources import catalog, corpus, runs
from veriframe.tables import DFD, THREAT_TYPES, invalid_pairs, load, mapping


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _named(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix), _s(c))


def _facts(rows: DataFrame, construct: str, id_: Column, file: Column, line: Column, pos: Column, **fields: Column) -> DataFrame:
    """Rows as facts of a construct; null fields are absent."""
    entries = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    at = line.cast("int")
    return rows.select(id_.alias("id"), F.lit(construct).alias("construct"), file.alias("file"), at.alias("line"), at.alias("end_line"), F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("fields"), F.lit(False).alias("derived"), F.lit("high").alias("confidence"), pos.cast("bigint").alias("pos"))


def _mounts_and_routes(spark: SparkSession, d: str) -> DataFrame:
    s, p = load(spark, d, "supplier"), load(spark, d, "part")
    k, n = F.col("s_suppkey"), F.col("p_partkey")
    mounts = _facts(s, "express_mount", _named("M", k), F.lit("server.js"), k, k, router_file=_named("r", k % 40), mount_path=F.concat(F.lit("/api/"), _s(k % 7), F.lit("/")))
    routes = _facts(p, "express_route", _named("R", n), _named("r", "p_size"), n, n, method=F.when(n % 2 == 0, "GET").otherwise("POST"), router_path=F.when(n % 5 == 0, "/").otherwise(F.concat(F.lit("/"), F.col("p_brand"), F.lit("/:id"))))
    return mounts.unionByName(routes)


_ROUTES = """
mounts AS (SELECT 'r' || (s_suppkey % 40) AS file, arg_max('/api/' || (s_suppkey % 7) || '/', s_suppkey) AS mount_path FROM supplier GROUP BY ALL),
routes AS (SELECT 'R' || p_partkey AS id, p_partkey AS line, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, file, mount_path, trim(mount_path, '/') AS m,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || '/:id' END AS r FROM part JOIN mounts ON file = 'r' || p_size)"""


@query(f"WITH {_ROUTES} SELECT id, method, file, mount_path, '/' || m || CASE WHEN r = '' THEN '' ELSE '/' || r END AS full_path FROM routes")
def route_table(spark: SparkSession, d: str) -> DataFrame:
    """J-09, N16: routes of mounted routers; of several mounts of a router the last counts, unmounted routers drop out."""
    return facts.routes(_mounts_and_routes(spark, d)).select("id", "method", "file", "mount_path", "full_path")


@query(f"WITH {_ROUTES} SELECT mount_path, string_agg(id, ',' ORDER BY file, line, id) AS routes FROM routes GROUP BY ALL")
def routes_by_mount(spark: SparkSession, d: str) -> DataFrame:
    """E-11, O-02: by mount, in the order of file and line."""
    return facts.routes_by_mount(facts.routes(_mounts_and_routes(spark, d))).select("mount_path", F.array_join("routes", ",").alias("routes"))


_MODELS = """
opt AS (SELECT 'm' || n_nationkey AS file, 's' || (n_nationkey % 3) AS v, 'opt' || n_nationkey AS o FROM nation WHERE n_nationkey % 4 > 0),
m AS (SELECT 'm' || (c_custkey % 60) AS file, c_custkey AS pos, 'K' || c_custkey AS id, ['user', 'policy', 'box'][1 + c_custkey % 3] AS model_name, CASE WHEN c_custkey % 5 = 0 THEN 'own' || c_custkey END AS e, 's' || (c_custkey % 3) AS v FROM customer),
j AS (SELECT m.*, o FROM m LEFT JOIN opt USING (file, v)),
c AS (SELECT file, arg_max({'model_name': model_name, 'collection': coalesce(e, o, CASE model_name WHEN 'user' THEN 'users' WHEN 'policy' THEN 'policies' ELSE 'boxes' END), 'model_fact_id': id,
   'source': CASE WHEN e IS NOT NULL THEN 'explicit_arg' WHEN o IS NOT NULL THEN 'schema_option' ELSE 'pluralization_rule' END,
   'confidence': CASE WHEN e IS NOT NULL OR o IS NOT NULL OR model_name = 'user' THEN 'high' ELSE 'low' END}, pos) AS r FROM j GROUP BY ALL),
models AS (SELECT file, r.* FROM c)"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    schemas = _facts(load(spark, d, "nation"), "mongoose_schema", _named("S", n), _named("m", n), n, n, schema_var=_named("s", n % 3), collection_option=F.when(n % 4 > 0, _named("opt", n)))
    name = F.element_at(F.array(F.lit("user"), F.lit("policy"), F.lit("box")), (k % 3 + 1).cast("int"))
    models = _facts(load(spark, d, "customer"), "mongoose_model", _named("K", k), _named("m", k % 60), k, k, model_name=name, schema_var=_named("s", k % 3), explicit_collection=F.when(k % 5 == 0, _named("own", k)))
    return schemas.unionByName(models)


@query(f"WITH {_MODELS} SELECT * FROM models")
def model_collections(spark: SparkSession, d: str) -> DataFrame:
    """J-12: explicit name, else schema option, else plural; the last model of a file."""
    return facts.collections(_models(spark, d)).select("file", "model_name", "collection", "model_fact_id", "source", "confidence")


@query(f"""WITH {_MODELS},
b AS (SELECT 'f' || (o_orderkey % 90) AS file, 'L' || (o_orderkey % 4) AS local_name, o_orderkey AS pos, 'm' || (o_custkey % 80) AS resolved_file FROM orders),
bound AS (SELECT b.file, local_name, arg_max({{'collection': collection, 'confidence': confidence, 'model_file': models.file}}, pos) AS r FROM b JOIN models ON models.file = resolved_file GROUP BY ALL)
SELECT 'A' || l_id AS from_fact_id, r.collection AS collection, CASE WHEN l_id % 3 = 0 THEN 'write' ELSE 'read' END AS access, r.confidence AS confidence, r.model_file AS model_file
FROM (SELECT o_orderkey AS l_id, 'f' || (o_custkey % 120) AS file, 'L' || (o_custkey % 5) AS local_name FROM orders) a JOIN bound USING (file, local_name)""")
def resolved_accesses(spark: SparkSession, d: str) -> DataFrame:
    """J-11, E-10, T-08: accesses of bound models, by way of binding, file and model; of a name's bindings the last counts."""
    o, k, c = load(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    all_of = _models(spark, d).unionByName(_facts(o, "require_binding", _named("B", k), _named("f", k % 90), k, k, local_name=_named("L", k % 4), resolved_file=_named("m", c % 80)))
    all_of = all_of.unionByName(_facts(o, "db_operation", _named("A", k), _named("f", c % 120), k, k, local_name=_named("L", c % 5), op=F.lit("x"), access=F.when(k % 3 == 0, "write").otherwise("read")))
    f = lambda n: F.try_element_at("fields", F.lit(n)).alias(n)
    return facts.resolved(all_of).where("construct = 'db_access'").select(f("from_fact_id"), f("collection"), f("access"), "confidence", f("model_file"))


@query("""
WITH f AS (SELECT p_partkey AS k, p_brand, p_size, p_type FROM part)
SELECT 'R' || k AS id, '[R' || k || '] fs_write src/' || p_brand || CASE WHEN p_size > 20 THEN ':' || p_size ELSE '' END || '  mechanism=' || p_type || '  path=up' || p_size || CASE WHEN p_size % 2 = 0 THEN '  (confidence: low)' ELSE '' END AS text FROM f
""")
def rendered_facts(spark: SparkSession, d: str) -> DataFrame:
    """F-19, P-08: facts as lines of text; suppressed constructs, empty lists and the origin's id are left out."""
    p, k = load(spark, d, "part"), F.col("p_partkey")
    line = F.when(F.col("p_size") > 20, F.col("p_size")).otherwise(0)
    shown = _facts(p, "fs_write", _named("R", k), F.concat(F.lit("src/"), "p_brand"), line, k, path=_named("up", "p_size"), mechanism=F.col("p_type"), from_fact_id=_named("Q", k), none=F.lit("[]"))
    shown = shown.join(p.select(_named("R", k).alias("id"), "p_size"), "id").withColumn("confidence", F.when(F.col("p_size") % 2 == 0, "low").otherwise("high")).drop("p_size")
    hidden = _facts(p, "module_export", _named("H", k), F.lit("a"), F.lit(1), k, name=F.lit("x"))
    return facts.rendered(shown.unionByName(hidden)).select("id", "text")


_V = """
c AS (SELECT 'N' || c_nationkey AS dfd_id, c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'C' || (c_custkey % 97) END AS eid, CASE WHEN c_custkey % 7 = 0 THEN 'Thing' ELSE 'Process' END AS etype, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS ename,
  CASE WHEN c_custkey % 5 = 0 THEN 'B' || (c_custkey % 4) END AS tb, c_custkey % 3 AS pe, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'F' || (c_custkey % 83) END AS fid,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'C' || (c_custkey % 97) END AS src, 'C' || (c_custkey * 3 % 150) AS dst, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'x' END AS descr, 'B' || (c_custkey % 6) AS cross_, c_custkey % 2 AS pf FROM customer),
e AS (SELECT *, 'elements[' || n || '] (' || eid || ')' AS w FROM c WHERE c_nationkey NOT IN (7, 9)),
f AS (SELECT *, 'flows[' || n || '] (' || fid || ')' AS w FROM c WHERE c_nationkey NOT IN (8, 9)),
t0 AS (SELECT 'N' || s_nationkey AS dfd_id, s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'B' || (s_suppkey % 4) END AS tid, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS tname, 'C' || s_suppkey AS has FROM supplier WHERE s_nationkey <> 9),
t AS (SELECT *, 'trust_boundaries[' || n || '] (' || tid || ')' AS w FROM t0),
d AS (SELECT 'N' || n_nationkey AS dfd_id, n_nationkey AS k, CASE WHEN n_nationkey % 5 = 4 THEN 1 ELSE n_nationkey % 5 END AS version FROM nation)"""
_AGAIN = "row_number() OVER (PARTITION BY dfd_id, {0} ORDER BY n) > 1"


@query(f"""WITH {_V}
SELECT dfd_id, 'V-1' AS rule, '' AS "where", 'top level must be an object' AS message FROM d WHERE k = 9
UNION ALL SELECT dfd_id, 'V-2', '', 'schema_version ' || version FROM d WHERE k <> 9 AND version NOT IN (1, 2)
UNION ALL SELECT dfd_id, 'V-3', '', '''elements'' must be a list' FROM d WHERE k IN (7, 9)
UNION ALL SELECT dfd_id, 'V-3', '', '''flows'' must be a list' FROM d WHERE k IN (8, 9)
UNION ALL SELECT dfd_id, 'V-4', w, 'missing element id' FROM e WHERE eid = ''
UNION ALL SELECT dfd_id, 'V-4', w, 'duplicate element id' FROM (SELECT *, {_AGAIN.format("eid")} AS again FROM e) WHERE again AND eid <> ''
UNION ALL SELECT dfd_id, 'V-5', w, 'type Thing' FROM e WHERE etype = 'Thing'
UNION ALL SELECT dfd_id, 'V-6', w, 'missing or empty ''name''' FROM e WHERE ename = ''
UNION ALL SELECT dfd_id, 'V-7', w || ': provenance[0]', CASE pe WHEN 1 THEN 'more than one vocabulary' ELSE 'no vocabulary' END FROM e WHERE pe > 0
UNION ALL SELECT dfd_id, 'V-7', w || ': provenance[0]', 'bbox is not four ints' FROM f WHERE pf = 1
UNION ALL SELECT dfd_id, 'V-8', w, 'missing flow id' FROM f WHERE fid = ''
UNION ALL SELECT dfd_id, 'V-8', w, 'duplicate flow id' FROM (SELECT *, {_AGAIN.format("fid")} AS again FROM f) WHERE again AND fid <> ''
UNION ALL SELECT dfd_id, 'V-9', w, 'missing ''source''' FROM f WHERE src = ''
UNION ALL SELECT dfd_id, 'V-9', w, 'source undeclared ' || src FROM f WHERE src <> '' AND (dfd_id, src) NOT IN (SELECT (dfd_id, eid) FROM e WHERE eid <> '')
UNION ALL SELECT dfd_id, 'V-9', w, 'destination undeclared ' || dst FROM f WHERE (dfd_id, dst) NOT IN (SELECT (dfd_id, eid) FROM e WHERE eid <> '')
UNION ALL SELECT dfd_id, 'V-10', w, 'missing or empty ''description''' FROM f WHERE descr IS NULL
UNION ALL SELECT dfd_id, 'V-11', w, 'missing trust boundary id' FROM t WHERE tid = ''
UNION ALL SELECT dfd_id, 'V-11', w, 'duplicate trust boundary id' FROM (SELECT *, {_AGAIN.format("tid")} AS again FROM t) WHERE again AND tid <> ''
UNION ALL SELECT dfd_id, 'V-11', w, 'missing or empty ''name''' FROM t WHERE tname = ''
UNION ALL SELECT dfd_id, 'V-12', w, 'contains undeclared ' || has FROM t WHERE (dfd_id, has) NOT IN (SELECT (dfd_id, eid) FROM e WHERE eid <> '')
UNION ALL SELECT dfd_id, 'V-13', w, 'undeclared trust boundary ' || tb FROM e WHERE tb IS NOT NULL AND (dfd_id, tb) NOT IN (SELECT (dfd_id, tid) FROM t)
UNION ALL SELECT dfd_id, 'V-14', w, 'crosses undeclared ' || cross_ FROM f WHERE (dfd_id, cross_) NOT IN (SELECT (dfd_id, tid) FROM t)
""")
def dfd_violations(spark: SparkSession, d: str) -> DataFrame:
    """V-1 to V-14, Z-08: a diagram for each nation, with every kind of fault."""
    k, n, s = F.col("c_custkey"), F.col("n_nationkey"), F.col("s_suppkey")
    types = {f.name: f.dataType for f in spark.createDataFrame([], DFD).schema}
    prov = lambda fact, file, line, box: F.array(F.struct(fact.cast("string").alias("fact_id"), file.cast("string").alias("file"), line.cast("int").alias("line"), box.cast("array<int>").alias("bbox"), F.lit(None).cast("string").alias("label_text")))
    no = F.lit(None)
    element = F.struct(F.when(k % 11 == 0, "").otherwise(_named("C", k % 97)).alias("id"), F.when(k % 7 == 0, "Thing").otherwise("Process").alias("type"), F.when(k % 13 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 == 0, _named("B", k % 4)).alias("trust_boundary"), prov(F.when(k % 3 < 2, "F1"), F.when(k % 3 == 1, "a"), F.when(k % 3 == 1, 3), no).alias("provenance"))
    flow = F.struct(F.when(k % 17 == 0, "").otherwise(_named("F", k % 83)).alias("id"), F.when(k % 19 == 0, "").otherwise(_named("C", k % 97)).alias("source"), _named("C", k * 3 % 150).alias("destination"), F.when(k % 23 > 0, "x").alias("description"), F.array(_named("B", k % 6)).alias("crosses_boundaries"), prov(no, no, no, F.when(k % 2 == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4))))).alias("provenance"))
    listed = lambda x, at: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), x.alias("x")))), lambda y: y["x"])
    own = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(listed(element, k).alias("e"), listed(flow, k).alias("f"))
    boundary = F.struct(F.when(s % 5 == 0, "").otherwise(_named("B", s % 4)).alias("id"), F.when(s % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), F.array(_named("C", s)).alias("contains"))
    tb = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(listed(boundary, s).alias("t"))
    out = load(spark, d, "nation").select("n_nationkey").join(own, "n_nationkey", "left").join(tb, "n_nationkey", "left")
    meta = F.struct(F.lit(None).cast("string").alias("scenario"), F.when(n % 5 < 4, n % 5).cast("int").alias("schema_version"))
    none = lambda name: F.array().cast(types[name])
    dfds = out.select(
        _named("N", n).alias("dfd_id"),
        F.when(n != 9, meta).cast(types["_meta"]).alias("_meta"),
        F.when(~n.isin(7, 9), F.coalesce(F.col("e").cast(types["elements"]), none("elements"))).alias("elements"),
        F.when(~n.isin(8, 9), F.coalesce(F.col("f").cast(types["flows"]), none("flows"))).alias("flows"),
        F.when(n != 9, F.coalesce(F.col("t").cast(types["trust_boundaries"]), none("trust_boundaries"))).alias("trust_boundaries"),
    )
    return violations(dfds)


@query(f"""WITH RECURSIVE {_GREEDY},
p AS (SELECT gen_index, gold_id FROM walk WHERE gold_id IS NOT NULL),
x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '?' ELSE 'PA' || lpad((list_position(['D', 'Dd', 'I', 'L', 'Nr'], {_TYPE_SQL}))::VARCHAR, 2, '0') END AS category, ts < '2024-01-16' AS old FROM events),
out_ AS (SELECT category, (p.gen_index IS NOT NULL)::INT AS tp, (p.gen_index IS NULL)::INT AS fp, 0 AS fn FROM x LEFT JOIN p ON p.gen_index = event_id WHERE NOT old
  UNION ALL SELECT category, 0, 0, 1 FROM x WHERE old AND event_id NOT IN (SELECT gold_id FROM p)),
c AS (SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM out_ GROUP BY ALL) SELECT *, {_PRF} FROM c""")
def confusion_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """A-03, J-07: by the parent of the action; a missed gold row counts under its first action's parent, one without a number under ?."""
    gen, gold = _threats(spark, d)
    names = ("D", "Dd", "I", "L", "Nr")
    of = lambda i: F.lit("error" if names[i] == "D" else f"PA{i + 1:02d}.01")
    at = F.array_position(F.array(*map(F.lit, names)), F.col("threat_type")).cast("int")
    codes = F.array(*map(of, range(5)))
    gold = gold.withColumn("panoptic_actions", F.array(F.element_at(codes, at), F.element_at(codes, at % 5 + 1)))
    gen = gen.withColumn("panoptic_action", F.element_at(codes, at))
    flows = load(spark, d, "events").select(_named("DF", "user_id").alias("id"), F.lit(0).alias("pos"), F.lit("").alias("source"), F.lit("").alias("destination")).distinct()
    return _rounded(metrics.by_parent(gen, gold, matching.match_actions(gen, gold, flows)))


@query("""
WITH RECURSIVE gold AS (SELECT s_suppkey AS id, s_suppkey % 3 AS t, s_suppkey % 20 AS f FROM supplier),
gl AS (SELECT t, list({'id': id, 'f': f} ORDER BY id) AS gold FROM gold GROUP BY ALL),
gn AS (SELECT item_id, item_id % 3 AS t, [item_id % 20, item_id * 7 % 20] AS fs, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS k FROM benchmark),
walk AS (SELECT t, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS gen_index, NULL::BIGINT AS gold_id FROM gl
  UNION ALL SELECT t, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, item_id, hit
  FROM (SELECT w.t, gn.k, w.used, gn.item_id, list_filter(gold, lambda x: list_contains(gn.fs, x.f) AND NOT list_contains(w.used, x.id))[1].id AS hit FROM walk w JOIN gn ON gn.t = w.t AND gn.k = w.k + 1 JOIN gl ON gl.t = w.t))
SELECT gen_index, gold_id FROM walk WHERE gold_id IS NOT NULL
""")
def match_findings(spark: SparkSession, d: str) -> DataFrame:
    """J-21, S-19: findings of another tool, each taking the first free gold row of its type that cites one of its flows."""
    i, s = F.col("item_id"), F.col("s_suppkey")
    findings = load(spark, d, "benchmark").select(i.alias("gen_index"), _s(i % 3).alias("threat_type"), F.array(_named("DF", i % 20), _named("DF", i * 7 % 20)).alias("flow_ids"))
    gold = load(spark, d, "supplier").select(s.alias("id"), s.alias("pos"), _s(s % 3).alias("threat_type"), F.concat(F.lit("[DF"), _s(s % 20), F.lit("]")).alias("interaction"))
    return matching.match_sets(findings, gold)


@query("""
WITH el AS (SELECT 'C' || c_custkey AS id, 'Name ' || (c_custkey % 40) AS name, c_custkey AS pos FROM customer),
n AS (SELECT name, arg_max(id, pos) AS id FROM el GROUP BY ALL),
l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '  C' || user_id || '   sends it' WHEN 1 THEN 'Name ' || (event_id % 60) ELSE 'nothing' END AS label, CASE WHEN event_id % 3 = 0 THEN 'C' || user_id END AS head FROM events)
SELECT event_id, coalesce(el.id, n.id) AS element, CASE WHEN el.id IS NOT NULL THEN 'by id' WHEN n.id IS NOT NULL THEN 'by name' ELSE 'unresolved' END AS how FROM l LEFT JOIN el ON el.id = head LEFT JOIN n ON n.name = label
""")
def label_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """J-21: labels of a drawing as elements: by the leading id, else by the whole name."""
    k, e = F.col("c_custkey"), F.col("event_id")
    elements = load(spark, d, "customer").select(_named("C", k).alias("id"), _named("Name ", k % 40).alias("name"), k.alias("pos"))
    label = F.when(e % 3 == 0, F.concat(F.lit("  C"), _s("user_id"), F.lit("   sends it"))).when(e % 3 == 1, _named("Name ", e % 60)).otherwise("nothing")
    return matching.endpoint(load(spark, d, "events").select(e, label.alias("label")), elements).select("event_id", "element", "how")


@query("""
WITH g AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'F' || o_orderkey ELSE 'C' || o_custkey END AS o, CASE WHEN o_orderkey % 6 = 0 THEN 'no flow' ELSE 'from a to b [F' || o_orderkey || ']' END AS i, CASE WHEN o_orderkey % 6 > 0 THEN 'F' || o_orderkey END AS cited FROM orders),
e AS (SELECT 'C' || c_custkey AS h, 'X' || min(c_custkey * 2) AS x FROM customer WHERE c_custkey % 3 > 0 GROUP BY c_custkey),
f AS (SELECT 'F' || l_orderkey AS h, min('Y' || (l_orderkey + l_linenumber)) AS x FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY l_orderkey),
j AS (SELECT g.*, e.x AS ex, fo.x AS fx, f.x AS cx FROM g LEFT JOIN e ON e.h = o LEFT JOIN f fo ON fo.h = o LEFT JOIN f ON f.h = cited)
SELECT id, coalesce(ex, fx, o) AS originator_id, CASE WHEN cited IS NULL THEN i WHEN cx IS NOT NULL THEN 'from a to b [' || cx || ']' ELSE 'from a to b' END AS interaction,
  nullif(concat_ws('; ', CASE WHEN coalesce(ex, fx) IS NULL THEN 'originator ' || o || ' has no counterpart' END, CASE WHEN cited IS NOT NULL AND cx IS NULL THEN 'flow ' || cited || ' has no counterpart' END), '') AS remap_note FROM j
""")
def reanchored_gold(spark: SparkSession, d: str) -> DataFrame:
    """J-27: originators and cited flows in another diagram's ids, and what was lost."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gold = load(spark, d, "orders").select(k.alias("id"), F.when(c % 4 == 0, _named("F", k)).otherwise(_named("C", c)).alias("originator_id"), F.when(k % 6 == 0, "no flow").otherwise(F.concat(F.lit("from a to b [F"), _s(k), F.lit("]"))).alias("interaction"))
    elements = load(spark, d, "customer").where("c_custkey % 3 > 0").select(_named("C", "c_custkey").alias("hand_id"), _named("X", F.col("c_custkey") * 2).alias("derived_id"))
    flows = load(spark, d, "lineitem").where("l_orderkey % 5 > 0").select(_named("F", "l_orderkey").alias("hand_id"), _named("Y", F.col("l_orderkey") + F.col("l_linenumber")).alias("derived_id"))
    return matching.reanchored(gold, elements, flows).select("id", "originator_id", "interaction", "remap_note")


_HAND = """
h AS (SELECT 'C' || c_custkey AS element_id, CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'route_mount' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 7 > 0 END AS implemented FROM customer)"""


def _hand(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(_named("C", k).alias("element_id"), F.when(k % 10 == 0, "none").otherwise("route_mount").alias("kind"), F.when(k % 4 > 0, k % 7 > 0).alias("implemented"))


_DERIVABLE = """SELECT count(*) FILTER (k = 1) AS matched, count(*) FILTER (k = 4) AS derivable_but_missed, count(*) FILTER (k = 2) AS structurally_underivable, count(*) FILTER (k = 3) AS unresolved_key, count(*) AS total,
  round(coalesce(count(*) FILTER (k = 1) / nullif(count(*), 0), 0), 6) AS raw_recall, round(coalesce(count(*) FILTER (k = 1) / nullif(count(*) FILTER (k IN (1, 4)), 0), 0), 6) AS derivable_recall FROM k"""


def _recalls(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("raw_recall", "derivable_recall")})


@query(f"""WITH {_HAND}, k AS (SELECT CASE WHEN element_id IN (SELECT 'C' || o_custkey FROM orders) THEN 1 WHEN NOT coalesce(implemented, true) THEN 2 WHEN kind = 'none' THEN 3 ELSE 4 END AS k FROM h) {_DERIVABLE}""")
def element_derivability(spark: SparkSession, d: str) -> DataFrame:
    """A-10: hand elements that were matched, could not be, have no key, or were missed; null is implemented."""
    aligned = load(spark, d, "orders").select(_named("C", "o_custkey").alias("hand"))
    return _recalls(align.element_derivability(_hand(spark, d), aligned))


@query(f"""WITH {_DFD}, {_HAND}, k AS (SELECT CASE WHEN fl.pos % 8 = 0 THEN 1 WHEN NOT coalesce(s.implemented, true) OR NOT coalesce(t.implemented, true) THEN 2
  WHEN (coalesce(s.implemented, true) AND s.kind = 'none') OR (coalesce(t.implemented, true) AND t.kind = 'none') THEN 3 ELSE 4 END AS k FROM fl LEFT JOIN h s ON s.element_id = source LEFT JOIN h t ON t.element_id = destination) {_DERIVABLE}""")
def flow_derivability(spark: SparkSession, d: str) -> DataFrame:
    """A-10 for flows: by their end points, some of which aren't declared."""
    _, fl = _diagram(spark, d)
    return _recalls(align.flow_derivability(fl, _hand(spark, d), fl.where("pos % 8 = 0").select(F.col("id").alias("hand"))))


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS derived, o_custkey // 3 AS hand FROM orders WHERE o_custkey % 2 = 0), f AS (SELECT o_orderkey AS derived, o_orderkey // 5 AS hand, o_orderkey % 7 = 0 AS amb FROM orders WHERE o_orderkey % 3 = 0)
SELECT (SELECT count(*) FROM customer) AS n_elements, (SELECT count(*) FROM orders) AS n_flows, (SELECT count(DISTINCT derived) FROM e) AS matched_elements, (SELECT count(DISTINCT derived) FROM f) AS matched_flows,
  round((SELECT count(DISTINCT derived) FROM e) / (SELECT count(*) FROM customer), 6) AS element_precision_raw, round((SELECT count(DISTINCT derived) FROM f) / (SELECT count(*) FROM orders), 6) AS flow_precision_raw,
  round((SELECT count(DISTINCT derived) / count(DISTINCT hand) FROM e), 6) AS element_granularity, round((SELECT count(DISTINCT derived) / count(DISTINCT hand) FROM f), 6) AS flow_granularity, (SELECT count(DISTINCT hand) FROM f WHERE amb) AS n_ambiguous
""")
def adapter_scores(spark: SparkSession, d: str) -> DataFrame:
    """A-11: raw precision, derived items for each matched hand item, ambiguous flows."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    el = o.where(n % 2 == 0).select(_s(n).alias("derived"), _s(F.floor(n / 3)).alias("hand")).distinct()
    fl = o.where(k % 3 == 0).select(_s(k).alias("derived"), _s(F.floor(k / 5)).alias("hand"), (k % 7 == 0).alias("ambiguous"))
    out = align.adapter_scores(c, o, el, fl)
    return out.withColumns({x: F.round(x, 6) for x in ("element_precision_raw", "flow_precision_raw", "element_granularity", "flow_granularity")})


@query("""
WITH f AS (SELECT 'R' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'express_route' ELSE 'fs_write' END AS construct, 'f' || (p_size % 30) AS file, p_partkey % 50 AS line, p_partkey % 4 = 0 AS derived FROM part),
re AS (SELECT * FROM f WHERE line % 3 > 0),
files AS (SELECT 'f' || i AS doc, 40 AS n_lines FROM range(25) r(i)),
i AS (SELECT s_suppkey, 'E' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'DataStore' WHEN 1 THEN 'Process' ELSE 'ExternalEntity' END AS type, 'R' || (s_suppkey * 3) AS fact, 'f' || (s_suppkey % 33) AS file, s_suppkey % 45 AS line, s_suppkey % 5 AS k FROM supplier),
ids AS (SELECT i.id, i.type, f.* EXCLUDE (id), f.id AS fid FROM i LEFT JOIN f ON f.id = i.fact WHERE k <> 0),
opens AS (SELECT id, type, i.file, i.line FROM i WHERE k IN (0, 1)),
bad AS (SELECT id FROM ids WHERE fid IS NULL UNION SELECT id FROM opens WHERE NOT EXISTS (SELECT 1 FROM files WHERE doc = opens.file AND line BETWEEN 1 AND n_lines)),
sup AS (SELECT id FROM ids WHERE (type = 'DataStore' AND construct = 'fs_write') OR (type = 'Process' AND construct = 'express_route')
  UNION SELECT o.id FROM opens o JOIN f USING (file, line) WHERE (type = 'DataStore' AND construct = 'fs_write') OR (type = 'Process' AND construct = 'express_route')),
gone AS (SELECT id FROM ids WHERE fid IS NOT NULL AND NOT derived AND NOT EXISTS (SELECT 1 FROM re WHERE re.construct = ids.construct AND re.file = ids.file AND re.line = ids.line)
  UNION SELECT id FROM opens WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.file = opens.file AND re.line = opens.line)),
v AS (SELECT id, id NOT IN (SELECT id FROM bad) AS citations_resolvable, id IN (SELECT id FROM sup) AS evidence_type_consistent, id NOT IN (SELECT id FROM gone) AS facts_present FROM i)
SELECT *, citations_resolvable AND evidence_type_consistent AND facts_present AS all_valid FROM v
""")
def verified_items(spark: SparkSession, d: str) -> DataFrame:
    """J-14, J-17, J-18, E-12, A-32: elements whose citations are ids, places or both, against facts and a re-extraction."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    known = _facts(load(spark, d, "part"), "x", _named("R", k), _named("f", F.col("p_size") % 30), k % 50, k).withColumn("n", F.substring("id", 2, 20).cast("bigint"))
    known = known.withColumn("construct", F.when(F.col("n") % 2 == 0, "express_route").otherwise("fs_write")).withColumn("derived", F.col("n") % 4 == 0).drop("n", "pos")
    files = spark.range(25).select(_named("f", "id").alias("doc"), F.lit(40).alias("n_lines"))
    p = lambda fact, file, line: F.struct(fact.cast("string").alias("fact_id"), file.cast("string").alias("file"), line.cast("int").alias("line"))
    no, place = F.lit(None), (_named("f", s % 33), s % 45)
    by_id, by_place = p(_named("R", s * 3), no, no), p(no, *place)
    items = load(spark, d, "supplier").select(_named("E", s).alias("id"), F.when(s % 3 == 0, "DataStore").when(s % 3 == 1, "Process").otherwise("ExternalEntity").alias("type"), F.when(s % 5 == 0, F.array(by_place)).when(s % 5 == 1, F.array(by_id, by_place)).otherwise(F.array(by_id)).alias("provenance"))
    out = accept.verify_items(items, known, known.where("line % 3 > 0"), files)
    return out.select("id", "citations_resolvable", "evidence_type_consistent", "facts_present", "all_valid")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS t, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE o_orderpriority END AS t, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 13 > 0)
SELECT a.k AS o_orderkey, concat_ws(';', CASE WHEN b.k IS NULL THEN 'missing' END, CASE WHEN b.t <> a.t THEN 'o_orderpriority differs' END, CASE WHEN b.v <> a.v THEN 'o_totalprice differs' END) AS issues FROM a LEFT JOIN b USING (k)
""")
def reconciled_sources(spark: SparkSession, d: str) -> DataFrame:
    """J-23, J-25: two sources of the same rows, merged one to one by key, with what differs."""
    a, k = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")), F.col("o_orderkey")
    b = a.where(k % 13 > 0).withColumn("o_orderpriority", F.when(k % 9 == 0, "other").otherwise(F.col("o_orderpriority"))).withColumn("o_totalprice", F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return facts.reconciled(a, b, "o_orderkey", ["o_orderpriority"], "o_totalprice").select("o_orderkey", F.array_join("issues", ";").alias("issues"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'src/a/up' || p_size WHEN 1 THEN 'src/x' || p_size ELSE 'b/c' || p_size END AS path, CASE WHEN p_size % 2 = 0 THEN 'Dd.' || p_size ELSE 'DDx.' || p_size END AS node,
  p_brand || '|' || p_size AS parts, CASE WHEN p_size % 3 = 0 THEN least(p_size * 2.5, 65.0) WHEN p_size % 3 = 1 THEN p_size * 100 / 1000.0 ELSE least(p_size * 1.0, 65.0) END::DOUBLE AS seconds, 2::INT AS n_labels, 'Store' AS second_name
FROM part
""")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """F-07, F-13, F-14, F-20, F-23."""
    n = F.col("p_size")
    raw = F.when(n % 3 == 0, _named("@dirname/./up", n)).when(n % 3 == 1, _named("@dirname/../x", n)).otherwise(F.concat(F.lit("./a/../b//c"), _s(n)))
    message = F.when(n % 3 == 0, F.concat(F.lit("Limit. Try again in "), _s(n * 2.5), F.lit("s."))).when(n % 3 == 1, F.concat(F.lit("try again in "), _s(n * 100), F.lit("ms"))).otherwise("busy")
    labels = X.label_items(F.concat(F.lit("Web server: it answers. Store: it keeps "), "p_brand"))
    return load(spark, d, "part").select(
        "p_partkey",
        X.resolve_path(raw, F.lit("src/a/f.js")).alias("path"),
        X.node_id(F.when(n % 2 == 0, F.concat(F.lit(" DD."), _s(n))).otherwise(F.concat(F.lit("DDx."), _s(n)))).alias("node"),
        F.array_join(X.comma_list(F.concat(F.lit(" "), "p_brand", F.lit(",, "), _s(n), F.lit(" ,"))), "|").alias("parts"),
        X.retry_after(message, _s(n)).alias("seconds"),
        F.size(labels).alias("n_labels"),
        F.element_at(labels, 2)["name"].alias("second_name"),
    )


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)
SELECT 'kb:p' || p_partkey || ':0' AS id, CASE p_partkey % 3 WHEN 0 THEN 'gold_threat' WHEN 1 THEN 'mapping_row' ELSE 'raw_json' END AS kind,
  CASE p_partkey % 3 WHEN 0 THEN 'threat #' || p_size || ' ' || p_name WHEN 1 THEN p_brand || '->' || p_name ELSE 'p' || p_partkey END AS section, CASE WHEN p_partkey % 3 = 0 THEN p_size END::BIGINT AS threat_id FROM p
UNION ALL SELECT 'kb:p' || p_partkey || ':1', 'mapping_invalid', 'invalid a->b', NULL FROM p WHERE p_partkey % 3 = 1
""")
def json_items(spark: SparkSession, d: str) -> DataFrame:
    """S-03: JSON documents of three shapes, one chunk for each item; an unknown shape is one raw chunk."""
    n = F.col("p_partkey")
    threat = F.to_json(F.struct(F.array(F.struct(F.col("p_size").alias("id"), F.col("p_name").alias("title"))).alias("threats")))
    row = F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("source"), F.col("p_name").alias("destination"), F.create_map(F.lit("L"), F.array(F.lit("S"))).alias("applicable_threats"))).alias("interactions"), F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("destination"), F.lit("why").alias("reason"))).alias("invalid_interactions")))
    docs = load(spark, d, "part").select(_named("p", n).alias("doc"), F.when(n % 3 == 0, threat).when(n % 3 == 1, row).otherwise(F.to_json(F.struct(F.col("p_size").alias("other")))).alias("text"))
    return corpus.json_chunks(docs, "kb").select("id", F.col("meta.kind").alias("kind"), "section", F.col("meta.threat_id").alias("threat_id"))


@query(f"""WITH {_DFD}, {_GG},
cls AS (SELECT CASE WHEN event_id IN (SELECT gold_id FROM pairs) THEN 'm' WHEN fid IS NULL OR source_type IS NULL OR dest_type IS NULL THEN 'u' WHEN ok THEN 'r' ELSE 's' END AS k
  FROM (SELECT gold.event_id, ctx.id AS fid, source_type, dest_type, coalesce(valid, false) AS ok FROM gold LEFT JOIN ctx ON ctx.pos = user_id))
SELECT count(*) FILTER (k = 'm') AS matched, count(*) FILTER (k = 'r') AS reachable_but_missed, count(*) FILTER (k = 's') AS structurally_unreachable, count(*) FILTER (k = 'u') AS unresolved_location,
  round(count(*) FILTER (k = 'm') / count(*), 6) AS raw_recall, round(count(*) FILTER (k = 'm') / count(*) FILTER (k IN ('m', 'r')), 6) AS reachable_recall FROM cls""")
def reachability_of_matches(spark: SparkSession, d: str) -> DataFrame:
    """J-32, A-09: after matching; a user's flow is the order of that number, where there is one."""
    gen, gold = _threats(spark, d)
    el, fl = _diagram(spark, d)
    fl = fl.withColumn("id", _named("DF", "pos"))
    pairs = matching.match(gen, gold)
    out = threats.breakdown(threats.reachability(gold, el, fl, mapping(spark), invalid_pairs(spark), matched=pairs))
    return out.withColumns({c: F.round(c, 6) for c in ("raw_recall", "reachable_recall")})


@query("""
WITH cell AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity > 49)
SELECT s_suppkey AS l_suppkey, run FROM (SELECT s_suppkey, unnest(range(1, 8))::INT AS run FROM supplier) s WHERE NOT EXISTS (SELECT 1 FROM cell WHERE l_suppkey = s_suppkey AND l_linenumber = run)
""")
def pending_of_a_sweep(spark: SparkSession, d: str) -> DataFrame:
    """S-24, X-01, Z-19: the cells of a sweep, supplier by run, that its state lacks."""
    planned = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("run"))
    done = load(spark, d, "lineitem").where("l_returnflag <> 'R' AND l_quantity > 49").select("l_suppkey", F.col("l_linenumber").cast("int").alias("run"))
    return runs.pending(planned, done, ["l_suppkey", "run"])


@query("""
WITH c AS (SELECT c_nationkey AS n, bool_or(c_custkey % 50 = 3 AND c_nationkey % 3 = 0) AS cites FROM customer GROUP BY ALL),
s AS (SELECT c_nationkey AS n, bool_and(c_nationkey % 4 > 0 OR c_custkey % 2 = 0) AS same FROM customer GROUP BY ALL)
SELECT n AS c_nationkey, cites AS cites_facts, same AS same_ids, CASE WHEN cites THEN 're-anchored' WHEN same THEN 'verbatim' ELSE 'unscorable' END AS route FROM c JOIN s USING (n)
""")
def gold_routes(spark: SparkSession, d: str) -> DataFrame:
    """P-19, P-20: a nation's customers as elements and flows; some cite facts, some lack half of the hand-made flows."""
    c, k, n = load(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    cite = F.array(F.struct(F.when((k % 50 == 3) & (n % 3 == 0), "F1").alias("fact_id")))
    flows = c.select("c_nationkey", _named("DF", k).alias("id"), F.array().cast("array<struct<fact_id:string>>").alias("provenance"))
    cites = comparison.cites_facts(c.select("c_nationkey", cite.alias("provenance")), flows, "c_nationkey")
    same = comparison.same_flow_ids(flows.where((n % 4 > 0) | (k % 2 == 0)), flows, "c_nationkey")
    return cites.join(same, "c_nationkey").withColumn("route", comparison.gold_route(F.col("cites_facts"), F.col("same_ids")))


_SIDES = """SELECT '{side}' AS side, (SELECT count(*) FROM gen)::BIGINT AS n_generated, count(*) AS n_gold, count(*) FILTER (k = 'm') AS matched, count(*) FILTER (k = 'r') AS reachable_but_missed, count(*) FILTER (k = 's') AS structurally_unreachable, count(*) FILTER (k = 'u') AS unresolved_location,
  round(coalesce(count(*) FILTER (k = 'm') / nullif(count(*), 0), 0), 6) AS raw_recall, round(coalesce(count(*) FILTER (k = 'm') / nullif(count(*) FILTER (k IN ('m', 'r')), 0), 0), 6) AS reachable_recall FROM {cls}"""


def _sided(n: int, keep: str) -> str:
    """Matching and classes of the gold rows that ``keep`` lets through."""
    return f"""
gold{n} AS (SELECT * FROM e WHERE ts < '2024-01-16' AND {keep}),
pairs{n} AS (SELECT a.event_id AS gen_index, b.event_id AS gold_id FROM (SELECT *, row_number() OVER (PARTITION BY threat_type, user_id ORDER BY event_id) AS n FROM gen) a JOIN (SELECT *, row_number() OVER (PARTITION BY threat_type, user_id ORDER BY event_id) AS n FROM gold{n}) b USING (threat_type, user_id, n)),
cls{n} AS (SELECT CASE WHEN event_id IN (SELECT gold_id FROM pairs{n}) THEN 'm' WHEN fid IS NULL OR source_type IS NULL OR dest_type IS NULL THEN 'u' WHEN ok THEN 'r' ELSE 's' END AS k
  FROM (SELECT g.event_id, ctx.id AS fid, source_type, dest_type, coalesce(valid, false) AS ok FROM gold{n} g LEFT JOIN ctx ON ctx.pos = user_id))"""


@query(f"""WITH {_DFD}, {_GG}, {_sided(1, "true")}, {_sided(2, "user_id % 3 > 0")}, rows_ AS ({_SIDES.format(side="all", cls="cls1")} UNION ALL {_SIDES.format(side="anchorable", cls="cls2")})
SELECT mode, rows_.* FROM (SELECT unnest(['grounded', 'rag', 'ungrounded']) AS mode) m LEFT JOIN rows_ ON mode = 'grounded'""")
def compared_recall(spark: SparkSession, d: str) -> DataFrame:
    """A-29, Z-15, P-17: recall on the whole catalog and on a part of it, by mode; modes that were not generated are empty."""
    gen, gold = _threats(spark, d)
    el, fl = _diagram(spark, d)
    fl = fl.withColumn("id", _named("DF", "pos"))
    gen = gen.withColumn("originator_id", F.lit("none")).withColumn("position", F.lit(None).cast("string"))
    nodes = spark.createDataFrame([(t, f"{t}.{i}") for t in THREAT_TYPES for i in range(3)], "threat_type string, node_id string")
    anchorable = gold.where(F.regexp_extract("interaction", r"\[DF(\d+)\]", 1).cast("bigint") % 3 > 0)
    rows = {("grounded", side): comparison.recall_row(spark, gen, g, el, fl, nodes).drop("citation_all_valid") for side, g in (("all", gold), ("anchorable", anchorable))}
    out = comparison.compared(rows, spark)
    return out.withColumns({c: F.round(c, 6) for c in ("raw_recall", "reachable_recall")})


@query(f"""WITH {_DFD}, c AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY ALL) SELECT {_TYPE_SQL.replace("event_type", "category")} AS threat_type, n FROM c""")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    """S-29, A-30: a catalog's distribution over types, as its builder records it."""
    gen, gold = _threats(spark, d)
    return gen.select("threat_type").unionByName(gold.select("threat_type")).groupBy("threat_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DFD},
th AS (SELECT event_id % 3 < 2 AS nv, 'F' || (event_id * 3) AS flow_id, event_id FROM events)
SELECT event_id % 4 AS run, round(avg(nv::INT), 6) AS node_valid_rate, count(*) AS n FROM th GROUP BY ALL""")
def gold_free_citations(spark: SparkSession, d: str) -> DataFrame:
    """A-08: citation rates without a catalog, by run."""
    e = F.col("event_id")
    checks = load(spark, d, "events").select((e % 4).alias("run"), (e % 3 < 2).alias("node_valid"), *(F.lit(True).alias(c) for c in ("type_applicable", "location_valid")), F.lit(None).cast("boolean").alias("position_applicable"))
    return metrics.gold_free_rates(checks, "run").select("run", F.round("node_valid_rate", 6).alias("node_valid_rate"), "n")




# diagrams, prompts and acceptance


@query(f"""WITH {_DFD}, n AS (SELECT t AS threat_type, t || '.' || i AS node_id FROM (SELECT unnest({list(THREAT_TYPES)}) AS t), (SELECT unnest([0, 1]) AS i))
SELECT id, threat_type, node_id, 3 AS n_positions FROM ctx, n WHERE valid""")
def context_nodes(spark: SparkSession, d: str) -> DataFrame:
    """J-03, R-09: the tree nodes of the types that apply to each flow."""
    el, fl = _diagram(spark, d)
    nodes = spark.createDataFrame([(t, f"{t}.{i}", "", "") for t in THREAT_TYPES for i in range(2)], "threat_type string, node_id string, title string, description string")
    c = threats.contexts(threats.with_endpoints(fl, el), mapping(spark), invalid_pairs(spark))
    return threats.context_nodes(c, nodes, "id").select("id", "threat_type", "node_id", F.size("positions").alias("n_positions"))


@query(f"""WITH {_DFD}, j AS (SELECT fl.id, s.name AS sn, s.type AS st, t.name AS tn, t.type AS tt FROM fl JOIN el s ON s.id = source JOIN el t ON t.id = destination),
p AS (SELECT id, sn || ' -> ' || tn || ': carries ' || id AS query, 'Name the threats.' || chr(10) || 'Flow ' || id || ': ' || sn || ' (' || st || ') -> ' || tn || ' (' || tt || ')' || chr(10) || 'carries ' || id || chr(10) || chr(10) || 'first' || chr(10) || 'second ' || id AS prompt FROM j)
SELECT id AS flow, query, sha256(prompt) AS prompt_sha256, length(prompt)::INT AS prompt_chars FROM p""")
def flow_prompts(spark: SparkSession, d: str) -> DataFrame:
    """P-01, P-02, Z-23, F-25: each flow's retrieval query, and its prompt's digest and length."""
    el, fl = _diagram(spark, d)
    f = threats.with_endpoints(fl, el, "inner").withColumn("description", _named("carries ", "id"))
    blocks = fl.select(F.col("id").alias("flow"), F.explode(F.array(F.struct(F.lit(2).alias("pos"), _named("second ", "id").alias("block")), F.struct(F.lit(1).alias("pos"), F.lit("first").alias("block")))).alias("b")).select("flow", "b.*")
    p = threats.prompts(f, blocks, "Name the threats.")
    return f.select(F.col("id").alias("flow"), threats.flow_query().alias("query")).join(p, "flow").select("flow", "query", "prompt_sha256", "prompt_chars")


@query("SELECT event_id AS gen_index, event_type AS threat_type, coalesce(CASE WHEN event_id % 3 = 0 THEN 'rag' END, CASE WHEN event_id % 2 = 0 THEN 'grounded' ELSE 'ungrounded' END) AS mode FROM events")
def threat_fields(spark: SparkSession, d: str) -> DataFrame:
    """P-03: known fields only; a missing mode follows the grounding."""
    e = F.col("event_id")
    t = load(spark, d, "events").select(e.alias("gen_index"), F.col("event_type").alias("threat_type"), F.when(e % 3 == 0, "rag").alias("mode"), (e % 2 == 0).alias("grounded"), "props")
    return threats.known_fields(t).drop("grounded")


@query("SELECT count(*) FILTER (event_id % 7 = 0 OR user_id % 11 = 0)::BIGINT AS malformed, count(*) AS rows FROM events")
def malformed_rows(spark: SparkSession, d: str) -> DataFrame:
    """P-14: malformed rows are counted, none is fatal."""
    e = load(spark, d, "events").select(F.when(F.col("event_id") % 7 > 0, "x").alias("flow_id"), F.when(F.col("user_id") % 11 > 0, "y").alias("threat_type"))
    return threats.well_formed(e, ["flow_id", "threat_type"])[1]


@query(f"WITH {_DFD}, g AS (SELECT event_id AS id, 'F' || (event_id * 5) AS cited FROM events) SELECT g.id, cited AS flow FROM g JOIN fl ON fl.id = cited")
def anchorable_gold(spark: SparkSession, d: str) -> DataFrame:
    """P-17, P-18: catalog rows whose flow this diagram has."""
    _, fl = _diagram(spark, d)
    e = F.col("event_id")
    g = load(spark, d, "events").select(e.alias("id"), e.alias("pos"), F.concat(F.lit("a [F"), _s(e * 5), F.lit("]")).alias("interaction"), *(F.lit(None).cast("string").alias(c) for c in ("dfd_source_id", "dfd_destination_id")))
    return threats.anchorable(g, fl).select("id", "flow")


@query("""
WITH r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'F' || (o_orderkey % 9000) END AS id, 'C' || o_custkey AS source, 'C' || (o_custkey * 5 % 2000) AS destination, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS descr, [o_orderkey % 40, o_orderkey % 70] AS ids FROM orders),
k AS (SELECT *, CASE WHEN id = '' THEN 'missing id' WHEN source NOT IN (SELECT 'C' || c_custkey FROM customer) OR destination NOT IN (SELECT 'C' || c_custkey FROM customer) THEN 'endpoint not an emitted element' WHEN ids[1] >= 25 AND ids[2] >= 25 THEN 'cites no resolvable fact' END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY pos) AS k FROM k)
SELECT pos, coalesce(bad, CASE WHEN k > 1 THEN 'duplicate' END) AS reason, CASE WHEN descr = '' THEN source || ' -> ' || destination ELSE descr END AS description FROM n
""")
def accepted_flows(spark: SparkSession, d: str) -> DataFrame:
    """P-10, N5: flows whose end points were kept and that cite a known fact, the first of an id; a default description."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = load(spark, d, "orders").select(k.alias("pos"), F.when(k % 31 == 0, "").otherwise(_named("F", k % 9000)).alias("id"), _named("C", c).alias("source"), _named("C", c * 5 % 2000).alias("destination"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("description"), F.array(_s(k % 40), _s(k % 70)).alias("fact_ids"))
    elements = load(spark, d, "customer").select(_named("C", "c_custkey").alias("id"))
    return accept.accept_flows(raw, elements, spark.range(25).select(_s("id").alias("id"))).select("pos", "reason", "description")


@query("""
WITH r AS (SELECT event_id AS pos, 'F' || (event_id % 3000) AS flow_id, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE ' note ' || event_id || ' ' END AS note, event_id % 40 AS f FROM events),
k AS (SELECT *, CASE WHEN flow_id NOT IN (SELECT 'F' || o_orderkey FROM orders) THEN 'not a flow in this DFD' WHEN trim(note) = '' THEN 'empty data_note' WHEN f >= 25 THEN 'cites no resolvable fact' END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY flow_id, bad IS NULL ORDER BY pos) AS k FROM k)
SELECT pos, coalesce(bad, CASE WHEN k > 1 THEN 'duplicate' END) AS reason, trim(note) AS data_note FROM n
""")
def accepted_notes(spark: SparkSession, d: str) -> DataFrame:
    """P-13: the first note of each flow that exists and that cites a known fact."""
    e = F.col("event_id")
    raw = load(spark, d, "events").select(e.alias("pos"), _named("F", e % 3000).alias("flow_id"), F.when(e % 5 == 0, "  ").otherwise(F.concat(F.lit(" note "), _s(e), F.lit(" "))).alias("data_note"), F.array(_s(e % 40)).alias("fact_ids"))
    flows = load(spark, d, "orders").select(_named("F", "o_orderkey").alias("id"))
    return accept.accept_enrichments(raw, flows, spark.range(25).select(_s("id").alias("id"))).select("pos", "reason", "data_note")


@query("""
SELECT event_id, concat_ws(';', CASE WHEN event_id % 4 > 0 THEN 'f' || (event_id % 9) || ':' || user_id END, CASE WHEN event_id % 6 = 1 THEN 'g:7' END) AS cited FROM events
""")
def cleaned_citations(spark: SparkSession, d: str) -> DataFrame:
    """P-12: citations with a file and a whole number, trimmed and typed; others are dropped."""
    e = F.col("event_id")
    c = lambda file, line: F.struct(file.alias("file"), line.alias("line"))
    given = F.array(c(F.when(e % 4 > 0, F.concat(F.lit(" f"), _s(e % 9), F.lit(" "))).otherwise(" "), _s("user_id")), c(F.lit("g"), F.when(e % 6 == 1, "7").when(e % 6 == 2, "7.5").otherwise("x")))
    clean = accept.clean_citations(given)
    return load(spark, d, "events").select(e, F.array_join(F.transform(clean, lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))), ";").alias("cited"))


@query("""
WITH o AS (SELECT DISTINCT p_size % 5 AS t, p_brand || '.' || p_size AS n FROM part WHERE p_partkey % 3 > 0), w AS (SELECT DISTINCT p_size % 5 AS t, p_brand || '.' || p_size AS n FROM part WHERE p_partkey % 7 > 2),
x AS (SELECT t, n, 1 AS k FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT t, n, 2 FROM (SELECT * FROM o EXCEPT SELECT * FROM w))
SELECT t AS threat_type, coalesce(string_agg(n, ',' ORDER BY n) FILTER (k = 1), '') AS added, coalesce(string_agg(n, ',' ORDER BY n) FILTER (k = 2), '') AS removed FROM x GROUP BY ALL
""")
def node_changes(spark: SparkSession, d: str) -> DataFrame:
    """Z-13: nodes added and removed between two versions of a tree, by type."""
    p = load(spark, d, "part").select((F.col("p_size") % 5).alias("threat_type"), F.concat("p_brand", F.lit("."), _s("p_size")).alias("node_id"), "p_partkey")
    out = crosswalk.node_diff(p.where("p_partkey % 3 > 0"), p.where("p_partkey % 7 > 2"))
    return out.select("threat_type", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("SELECT 'f' || p_size AS doc, max(p_partkey)::INT AS n_lines FROM part GROUP BY ALL")
def fact_files(spark: SparkSession, d: str) -> DataFrame:
    """Z-09: the largest line that facts name in each file."""
    k = F.col("p_partkey")
    return accept.files_of(_facts(load(spark, d, "part"), "x", _named("R", k), _named("f", "p_size"), k, k, a=F.lit("b")))


@query(f"""WITH {_ROUTES},
roles AS (SELECT 'r' || (n_nationkey % 4) AS k, string_agg('N' || n_nationkey, ',' ORDER BY 'N' || n_nationkey) AS facts FROM (SELECT n_nationkey FROM nation) GROUP BY ALL),
mp AS (SELECT '/api/' || (s_suppkey % 7) || '/' AS k, arg_max('M' || s_suppkey, s_suppkey) AS i FROM supplier GROUP BY ALL),
rt AS (SELECT mount_path, string_agg(id, ',' ORDER BY id) AS r FROM routes GROUP BY ALL),
st AS (SELECT 'box' || (r_regionkey % 3) AS k, string_agg('W' || r_regionkey, ',' ORDER BY 'W' || r_regionkey) AS facts FROM region GROUP BY ALL),
a AS (SELECT 'ExternalEntity' AS type, 'EE' AS p, k, k || ' (actor role)' AS name, facts FROM roles
  UNION ALL SELECT 'Process', 'P', k, k, concat_ws(',', i, r) FROM mp LEFT JOIN rt ON mount_path = k
  UNION ALL SELECT 'DataStore', 'DS', k, 'Browser ' || k, facts FROM st)
SELECT p || row_number() OVER (PARTITION BY p ORDER BY k) AS id, type, name, facts AS fact_ids FROM a""")
def implied_elements(spark: SparkSession, d: str) -> DataFrame:
    """A-20: an element for each role, mount and store that facts name, numbered in sorted order, with the facts."""
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    roles = _facts(load(spark, d, "nation"), "role_check", _named("N", n), F.lit("a"), n, n, roles=F.concat(F.lit('["r'), _s(n % 4), F.lit('"]')))
    stores = _facts(load(spark, d, "region"), "web_storage_access", _named("W", r), F.lit("b"), r, r, store=_named("box", r % 3))
    out = facts.elements(_mounts_and_routes(spark, d).unionByName(roles).unionByName(stores))
    return out.select("id", "type", "name", F.array_join("fact_ids", ",").alias("fact_ids"))


@query("""
WITH acc AS (SELECT o_orderkey AS k, o_custkey % 60 AS route, o_custkey % 25 AS coll, o_orderkey % 3 = 0 AS write FROM orders),
fl AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS fwd, o_custkey % 10 AS proc, o_custkey % 30 AS store FROM orders),
e AS (SELECT fl.k, fwd, store < 25 AS declared, route % 10 = proc AND coll = store AS hit, write FROM fl JOIN acc USING (k))
SELECT 'F' || k AS id, declared AS endpoints_declared, declared AND hit AS evidence_connects, CASE WHEN declared AND hit THEN fwd = write END AS direction_matches FROM e
""")
def flow_evidence(spark: SparkSession, d: str) -> DataFrame:
    """J-19: whether the access that a flow cites joins its end points, and which way the data moves."""
    o, k, c = load(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    i = F.col("id")
    mounts = _facts(spark.range(10), "express_mount", _named("M", i), F.lit("s"), i, i, router_file=_named("r", i), mount_path=_named("/m", i))
    routes = _facts(spark.range(60), "express_route", _named("R", i), _named("r", i % 10), i, i, method=F.lit("GET"), router_path=_named("/", i))
    stores = _facts(spark.range(25), "mongo_collection", _named("K", i), F.lit("m"), i, i, collection=_named("c", i))
    uses = _facts(o, "db_access", _named("A", k), F.lit("x"), F.lit(1), k, route_fact_id=_named("R", c % 60), collection=_named("c", c % 25), access=F.when(k % 3 == 0, "write").otherwise("read"))
    prov = lambda x: F.array(F.struct(x.alias("fact_id"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")))
    el = spark.range(10).select(_named("P", i).alias("id"), F.lit("Process").alias("type"), prov(_named("M", i)).alias("provenance")).unionByName(spark.range(25).select(_named("D", i).alias("id"), F.lit("DataStore").alias("type"), prov(_named("K", i)).alias("provenance")))
    p, s, fwd = _named("P", c % 10), _named("D", c % 30), k % 2 == 0
    fl = o.select(_named("F", k).alias("id"), F.when(fwd, p).otherwise(s).alias("source"), F.when(fwd, s).otherwise(p).alias("destination"), prov(_named("A", k)).alias("provenance"))
    return accept.evidence_links(fl, el, mounts.unionByName(routes).unionByName(stores).unionByName(uses).drop("pos"))


@query("""
WITH f AS (SELECT o_orderkey AS k, 'F' || o_orderkey AS id FROM orders)
SELECT id, 'flow id set changed' AS problem FROM f WHERE k % 50 = 1
UNION ALL SELECT id, 'endpoints changed' FROM f WHERE k % 50 = 2
UNION ALL SELECT id, 'original description not preserved as prefix' FROM f WHERE k % 50 = 3
UNION ALL SELECT id, 'enrichment cites unresolvable fact id Q' || k FROM f WHERE k % 50 = 4
""")
def enrichment_faults(spark: SparkSession, d: str) -> DataFrame:
    """J-34, T-06: how enriched flows break their contract: lost flows, moved ends, changed texts, ids that don't resolve."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    none = F.array().cast("array<struct<fact_id:string,file:string,line:int>>")
    before = o.select(_named("F", k).alias("id"), F.lit("a").alias("source"), F.lit("b").alias("destination"), _named("text ", k).alias("description"), none.alias("provenance"))
    after = o.where(k % 50 != 1).select(_named("F", k).alias("id"), F.when(k % 50 == 2, "z").otherwise("a").alias("source"), F.lit("b").alias("destination"), F.when(k % 50 == 3, "other").otherwise(F.concat(_named("text ", k), F.lit(" and more"))).alias("description"), none.alias("provenance"), F.array(F.when(k % 50 == 4, _named("Q", k)).otherwise("F1")).alias("fact_ids"))
    el = load(spark, d, "customer").select(_named("C", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return accept.enrichment_violations(before, after, el, el, spark.createDataFrame([("F1",)], "id string"))


@query("""
WITH l AS (SELECT p_brand AS doc, p_partkey AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_partkey % 5 = 0 AS head, 'L.1.' || p_size AS node, p_name AS title FROM part),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS sec FROM l)
SELECT doc, max(node) FILTER (head) AS node_id, max(title) FILTER (head) AS title, coalesce(string_agg('word' || n || ' ends', ' ' ORDER BY n) FILTER (NOT head), '') AS body FROM s WHERE sec > 0 GROUP BY doc, sec
""")
def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    """S-15, W-08, W-10: nodes from lines of text; a line that ends in a hyphen is joined to the next without it."""
    p, k = load(spark, d, "part"), F.col("p_partkey")
    head = k % 5 == 0
    each = F.when(head, F.array(F.concat(F.lit("L.1."), _s("p_size"), F.lit(" "), "p_name"))).otherwise(F.array(F.concat(F.lit("  word"), _s(k), F.lit(" en-")), F.lit("ds")))
    lines = p.select(F.col("p_brand").alias("doc"), k, F.posexplode(each).alias("i", "line")).select("doc", (k * 2 + F.col("i")).alias("n"), "line")
    return crosswalk.tree_lines(lines)


@query(f"""WITH {_GG}, c AS (SELECT t.threat_type AS category, coalesce(sum(tp), 0)::INT AS tp, coalesce(sum(fp), 0)::INT AS fp, coalesce(sum(fn), 0)::INT AS fn
  FROM (SELECT unnest({list(THREAT_TYPES)}) AS threat_type) t LEFT JOIN out_ USING (threat_type) GROUP BY ROLLUP (t.threat_type))
SELECT rpad(coalesce(category, 'ALL'), 10, ' ') || ' ' || lpad(tp::VARCHAR, 5, ' ') || ' ' || lpad(fp::VARCHAR, 5, ' ') || ' ' || lpad(fn::VARCHAR, 5, ' ') AS line FROM c""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """S-22: a report's lines without the three rates; counts above 99999 stay whole, where the SQL's lpad keeps five digits."""
    gen, gold = _threats(spark, d)
    lines = runs.report(metrics.by_type(gen, gold, matching.match(gen, gold)))
    return lines.select(F.regexp_replace("line", r"( +\S+){3}$", "").alias("line"))


@query("SELECT page_id FROM pages WHERE page_id % 4 > 1 OR page_id % 4 = 1 AND page_id % 3 > 0")
def kept_files(spark: SparkSession, d: str) -> DataFrame:
    """S-01, S-04: a scenario's files without diagrams and derived folders."""
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("s_derived/"), _s(k), F.lit(".md"))).when((k % 4 == 1) & (k % 3 == 0), F.concat(F.lit("s/"), _s(k), F.lit("/dfd.json"))).otherwise(F.concat(F.lit("s/"), _s(k), F.lit(".md")))
    return load(spark, d, "pages").withColumn("doc", path).where(corpus.kept("doc", "scenarios")).select("page_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def only_ok_rows(spark: SparkSession, d: str) -> DataFrame:
    """P-16: rows whose status is ok or absent."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "ok")
    return runs.only_ok(load(spark, d, "events").withColumn("status", status)).select("event_id")


@query(f"""WITH g AS (SELECT user_id % 7 AS catalog, {_TYPE_SQL} AS t FROM events), n AS (SELECT catalog, t, count(*) AS n FROM g GROUP BY ALL)
SELECT catalog, sum(n)::BIGINT AS count, string_agg(t || '=' || n, ',' ORDER BY t) AS type_distribution FROM n GROUP BY ALL""")
def catalog_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """S-29: what a catalog's builder records: its size and its distribution over types."""
    e = load(spark, d, "events").select((F.col("user_id") % 7).alias("catalog"), _type_of().alias("threat_type"))
    out = catalog.described(e, "catalog")
    pairs = F.transform(F.map_entries("type_distribution"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return out.select("catalog", "count", F.array_join(pairs, ",").alias("type_distribution"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 > 0 THEN o_custkey END ELSE o_orderkey END AS row FROM orders")
def catalog_source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Z-10: the source row of each catalog row: an override, which may say that there is none, else its own id."""
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    overrides = o.where(k % 10 == 0).select(k.alias("id"), F.when(k % 20 > 0, F.col("o_custkey")).alias("row"))
    return catalog.source_rows(o.select(k.alias("id")), overrides)


@query("SELECT p_partkey, p_size % 3 = 1 AS broken FROM part")
def broken_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Z-14: rows whose ranking breaks the formula, among rows with other issues."""
    n = F.col("p_size") % 3
    issues = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("title differs"), F.lit("formula: 0.3, not 0.4"))).otherwise(F.array(F.lit("the formula: unclear")))
    return load(spark, d, "part").select("p_partkey", catalog.broken_formula(issues).alias("broken"))


@query("SELECT p_brand AS node_id, coalesce(arg_max(t, p_partkey), '') AS title FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS t FROM part) GROUP BY ALL")
def node_titles(spark: SparkSession, d: str) -> DataFrame:
    """Z-14, Z-07: titles of nodes; of a node in several trees the last one's."""
    k = F.col("p_partkey")
    return catalog.titles(load(spark, d, "part").select(F.col("p_brand").alias("node_id"), k.alias("threat_type"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("title")))


@query("""
WITH lines AS (SELECT conv_id, turn, unnest(list_concat(['## ' || role], string_split(text, chr(10)))) AS line, generate_subscripts(list_concat(['## ' || role], string_split(text, chr(10))), 1) AS k FROM conversations),
m AS (SELECT *, (line LIKE '## %' OR line LIKE '# %')::INT AS mark FROM lines),
s AS (SELECT *, sum(mark) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) AS sec FROM m),
g AS (SELECT conv_id, sec, coalesce(max(CASE WHEN mark = 1 THEN trim(ltrim(line, '# ')) END), '') AS section, regexp_replace(string_agg(CASE WHEN mark = 0 THEN line END, chr(10) ORDER BY turn, k), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY conv_id, sec),
c AS (SELECT conv_id, sec, section, body, unnest(CASE WHEN length(body) > 700 THEN range(0, length(body), 600) ELSE [0] END) AS start FROM g WHERE body <> '')
SELECT 'conversations:' || conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY sec, start) - 1) AS id, section, md5(substr(body, start + 1, 700)) AS digest FROM c
""")
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """S-02, W-01: chunks of documents in Markdown with their running ids."""
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return corpus.markdown_chunks(c.select(_s("conv_id").alias("doc"), "text"), "conversations").select("id", "section", F.md5("text").alias("digest"))


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 18 AS x, p_partkey * 7 % 23 - 2 AS y, p_size % 6 AS w, 4 AS h FROM part),
c AS (SELECT *, greatest(0, least(20, x + w) - greatest(0, x)) * greatest(0, least(20, y + h) - greatest(0, y)) AS area, greatest(0, least(15, x + w) - greatest(5, x)) * greatest(0, least(15, y + h) - greatest(5, y)) AS ink FROM b)
SELECT p_partkey, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 20 AND y + h <= 20 AS citations_resolvable, area > 0 AND ink / area > 0.005 AS region_has_content FROM c
""")
def image_boxes(spark: SparkSession, d: str) -> DataFrame:
    """F-21, A-26, U-06: boxes on an image with a dark square on a plain ground: inside it, and drawn on or not."""
    k = F.col("p_partkey")
    grey = bytes(0 if 5 <= x < 15 and 5 <= y < 15 else 200 for y in range(20) for x in range(20))
    images = spark.createDataFrame([(i, 20, 20, bytearray(grey)) for i in range(7)], "image int, width int, height int, grey binary")
    boxes = load(spark, d, "part").select((k % 7).cast("int").alias("image"), _s(k).alias("item"), F.array(k % 18, k * 7 % 23 - 2, F.col("p_size") % 6, F.lit(4)).cast("array<int>").alias("box"))
    out = raster.item_checks(boxes.select("image", "item"), raster.box_checks(boxes, images, 1.0))
    return out.select(F.col("item").cast("bigint").alias("p_partkey"), "citations_resolvable", "region_has_content")
