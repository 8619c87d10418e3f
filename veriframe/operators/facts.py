"""J-09 to J-13, J-20, A-20, A-21, E-10, E-11, F-06 to F-09, F-18, F-19: facts about source code, and the diagram they imply.

Facts are rows (id, construct, file, line, end_line, fields map<string,string>, derived, confidence); lists in ``fields``
are JSON arrays. ``pos`` is the order of the input where the last of several wins; without it the id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.text import PLAIN_PLURALS, canonical_path, fact_id, json_object, pluralize, resolve_path, url_base
from veriframe.operators.crosswalk import in_order

_LIST = "array<string>"


def field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def fields_of(facts: DataFrame, construct: str | tuple[str, ...], *names: str) -> DataFrame:
    """The facts of a construct with some fields as columns."""
    wanted = (construct,) if isinstance(construct, str) else construct
    return facts.where(F.col("construct").isin(*wanted)).select("id", "construct", "file", "line", "end_line", "confidence", _pos(facts).alias("pos"), *(field(n).alias(n) for n in names))


def _pos(facts: DataFrame) -> Column:
    return F.col("pos") if "pos" in facts.columns else F.lit(0)


def list_of(c: str | Column) -> Column:
    return F.coalesce(F.from_json(c, _LIST), F.array().cast(_LIST))


def routes(facts: DataFrame) -> DataFrame:
    """J-09, N16: (id, method, router_path, file, mount_path, full_path, line): routes of mounted routers; of a router's mounts the last counts."""
    order = F.struct("pos", "id")
    mounts = fields_of(facts, "express_mount", "router_file", "mount_path").where("router_file is not null").groupBy("router_file").agg(F.max_by("mount_path", order).alias("mount_path"))
    r = fields_of(facts, "express_route", "method", "router_path")
    parts = F.filter(F.array(F.btrim("mount_path", F.lit("/")), F.btrim("router_path", F.lit("/"))), lambda p: p != "")
    out = r.join(mounts, r["file"] == mounts["router_file"])
    return out.select("id", "method", "router_path", "file", "mount_path", F.concat(F.lit("/"), F.array_join(parts, "/")).alias("full_path"), "line")


def routes_by_mount(table: DataFrame) -> DataFrame:
    """E-11: (mount_path, routes): ids in the order of file and line."""
    return table.groupBy("mount_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "id"))), lambda x: x["id"]).alias("routes"))


def dispatched(calls: DataFrame, table: DataFrame, key: str, method: str = "method", path: str = "path") -> DataFrame:
    """J-10, W-05: calls with the first route, by (file, line), whose method, number of segments and segments fit; ``{p}`` fits any.

    Calls and routes meet by method, number of segments and each route's literal segments: a route is looked up by its
    pattern, of which a call has one for each set of places that routes of its size use as parameters.
    """
    seg = lambda c: F.split(F.btrim(canonical_path(c), F.lit("/")), "/")
    r = table.withColumn("_h", seg("full_path")).withColumn("_n", F.size("_h"))
    r = r.withColumn("_mask", F.transform("_h", lambda s: s == "{p}"))
    c = calls.withColumn("_w", seg(path)).withColumn("_n", F.size("_w")).withColumn("_m", F.upper(method))
    masks = r.select("_n", "_mask").distinct()
    probes = c.join(masks, "_n").withColumn("_key", F.array_join(F.zip_with("_w", "_mask", lambda w, m: F.when(m, "{p}").otherwise(w)), "/"))
    table_ = r.select(F.col("method").alias("_m"), F.array_join("_h", "/").alias("_key"), F.struct("file", "line", "id", "mount_path", "full_path").alias("_route"))
    hit = probes.join(table_, ["_m", "_key"]).groupBy(key).agg(F.min("_route").alias("_route"))
    return calls.join(hit, key, "left").select(calls["*"], F.col("_route.id").alias("route_id"), F.col("_route.mount_path").alias("mount_path"), F.col("_route.file").alias("router_file"), F.col("_route.full_path").alias("full_path"))


def collections(facts: DataFrame) -> DataFrame:
    """J-12: (file, model_name, collection, model_fact_id, source, rule, confidence): explicit name, schema option, plural; the last model of a file counts."""
    models = fields_of(facts, "mongoose_model", "model_name", "explicit_collection", "schema_var")
    options = fields_of(facts, "mongoose_schema", "collection_option", "schema_var").where("coalesce(collection_option, '') <> ''")
    options = options.groupBy(F.col("file").alias("_f"), F.col("schema_var").alias("_v")).agg(F.max_by("collection_option", F.struct("pos", "id")).alias("option"))
    m = models.join(options, (F.col("file") == F.col("_f")) & (F.col("schema_var") == F.col("_v")), "left").withColumn("_p", pluralize("model_name"))
    explicit = F.nullif("explicit_collection", F.lit(""))
    out = m.select(
        "file", "pos", "id", "model_name",
        F.coalesce(explicit, "option", "_p.collection").alias("collection"),
        F.when(explicit.isNotNull(), "explicit_arg").when(F.col("option").isNotNull(), "schema_option").otherwise("pluralization_rule").alias("source"),
        F.when(explicit.isNotNull(), "mongoose.model arg 3").when(F.col("option").isNotNull(), "new Schema({}, {collection})").otherwise(F.col("_p.rule")).alias("rule"),
        F.when(explicit.isNotNull() | F.col("option").isNotNull() | F.col("_p.rule").isin(*PLAIN_PLURALS), "high").otherwise("low").alias("confidence"),
    )
    last = out.groupBy("file").agg(F.max_by(F.struct("model_name", "collection", F.col("id").alias("model_fact_id"), "source", "rule", "confidence"), F.struct("pos", "id")).alias("r"))
    return last.select("file", "r.*")


def bindings(facts: DataFrame, models: DataFrame) -> DataFrame:
    """J-11: (file, local_name, collection ...): local name to module to that module's model; the last binding of a name counts."""
    b = fields_of(facts, ("require_binding", "es_import_binding"), "local_name", "resolved_file").where("resolved_file is not null")
    b = b.join(models.select(F.col("file").alias("model_file"), "model_name", "collection", F.col("confidence").alias("model_confidence")), F.col("resolved_file") == F.col("model_file"))
    return b.groupBy("file", "local_name").agg(F.max_by(F.struct("model_file", "model_name", "collection", "model_confidence"), F.struct("pos", "id")).alias("r")).select("file", "local_name", "r.*")


def base_path(facts: DataFrame) -> DataFrame:
    """A-23: one row (prefix, confidence): the path that all base URLs agree on, else empty."""
    paths = fields_of(facts, "http_client_config", "base_url_branches").select(F.explode(list_of("base_url_branches")).alias("u")).select(url_base("u").alias("p"))
    same = F.count_distinct("p") == 1
    return paths.agg(F.when(same, F.min("p")).otherwise("").alias("prefix"), F.when(same, "high").otherwise("low").alias("confidence"))


def _derived(rows: DataFrame, construct: str, names: list[str]) -> DataFrame:
    fields = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"f_{n}").cast("string") for n in names))), lambda k, v: F.lit(True))
    text = json_object(fields)
    return rows.select(fact_id(F.lit(construct), "file", "line", text).alias("id"), F.lit(construct).alias("construct"), "file", "line", "end_line", fields.alias("fields"), F.lit(True).alias("derived"), "confidence")


def resolved(facts: DataFrame) -> DataFrame:
    """E-10, T-08, O-01: the facts and those that follow from them across files, each citing the one it comes from.

    mongo_collection of each model file, db_access of operations on bound models, fs_location of writes and static
    mounts, http_route_binding of client calls. Order by (file, line, construct, id) where order matters.
    """
    models = collections(facts)
    f = lambda **k: [c.alias(f"f_{n}") for n, c in k.items()]
    c = F.col
    first = models.select("file", F.lit(0).alias("line"), F.lit(0).alias("end_line"), "confidence", *f(model_name=c("model_name"), collection=c("collection"), resolved_via=c("source"), rule=c("rule"), from_fact_id=c("model_fact_id"), model_file=c("file")))
    out = _derived(first, "mongo_collection", ["model_name", "collection", "resolved_via", "rule", "from_fact_id", "model_file"])
    ops = fields_of(facts, "db_operation", "local_name", "op", "access", "route_fact_id").join(bindings(facts, models), ["file", "local_name"])
    ops = ops.select("file", "line", "end_line", c("model_confidence").alias("confidence"), *f(collection=c("collection"), model_name=c("model_name"), op=c("op"), access=c("access"), route_fact_id=c("route_fact_id"), from_fact_id=c("id"), model_file=c("model_file")))
    out = out.unionByName(_derived(ops, "db_access", ["collection", "model_name", "op", "access", "route_fact_id", "from_fact_id", "model_file"]))
    files = fields_of(facts, ("fs_write", "express_static_mount"), "fs_path", "mechanism").withColumn("_p", F.nullif(resolve_path("fs_path", "file"), F.lit(""))).where("_p is not null")
    files = files.select("file", "line", "end_line", F.lit("high").alias("confidence"), *f(fs_path=c("_p"), from_fact_id=c("id"), mechanism=F.coalesce("mechanism", F.lit("express.static"))))
    out = out.unionByName(_derived(files, "fs_location", ["fs_path", "from_fact_id", "mechanism"]))
    calls = fields_of(facts, "http_client_call", "method", "path_literal", "path_expr").crossJoin(F.broadcast(base_path(facts).withColumnRenamed("confidence", "_pc")))
    raw = F.btrim(F.btrim(F.coalesce(F.nullif("path_literal", F.lit("")), "path_expr", F.lit("")), F.lit("`'\"")), F.lit("/"))
    calls = calls.withColumn("path", F.concat("prefix", F.when(raw != "", F.concat(F.lit("/"), raw)).otherwise("")))
    calls = dispatched(calls, routes(facts), "id")
    calls = calls.select("file", "line", "end_line", F.when(c("route_id").isNotNull(), c("_pc")).otherwise("low").alias("confidence"), *f(absolute_path=canonical_path("path"), method=c("method"), route_fact_id=c("route_id"), mount_path=c("mount_path"), router_file=c("router_file"), from_fact_id=c("id"), base_path=c("prefix")))
    out = out.unionByName(_derived(calls, "http_route_binding", ["absolute_path", "method", "route_fact_id", "mount_path", "router_file", "from_fact_id", "base_path"]))
    return facts.select(*out.columns).unionByName(out)


def enclosing(points: DataFrame, spans: DataFrame, point: str, by: list[str] | None = None, at: str = "line", start: str = "line", end: str = "end_line", span: str = "id", bucket: int = 256) -> DataFrame:
    """J-13, W-06: points with ``span_id``, the shortest span of the same group that holds them; of equals the first that starts.

    A span is in each bucket of ``bucket`` positions that it touches and a point in one, so an interval join is an
    equi-join on group and bucket. Spans that touch over 64 buckets are matched by coarser ones, so that a long span
    isn't copied without bound.
    """
    by = by or ["file"]
    width = F.greatest(F.col(end) - F.col(start), F.lit(0))
    # level 0: buckets of ``bucket``; each level is 64 times as coarse
    level = F.when(width < bucket * 64, 0).when(width < bucket * 4096, 1).when(width < bucket * 262144, 2).otherwise(3)
    size = F.element_at(F.array(*(F.lit(bucket * 64**i) for i in range(4))), F.col("_level") + 1)
    s = spans.select(*by, F.col(span).alias("_span"), F.col(start).alias("_a"), F.col(end).alias("_b"), level.alias("_level"))
    s = s.where("_b >= _a").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_b") / size))))
    p = points.select(*by, F.col(point).alias("_point"), F.col(at).alias("_at"), F.explode(F.array(*map(F.lit, range(4)))).alias("_level")).withColumn("_bucket", F.floor(F.col("_at") / size))
    hit = p.join(s, [*by, "_level", "_bucket"]).where("_at between _a and _b")
    best = hit.groupBy("_point").agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("w"), "_a", "_span")).alias("_best"))
    return points.join(best, F.col(point) == F.col("_point"), "left").select(points["*"], F.col("_best._span").alias("span_id"))


def elements(facts: DataFrame) -> DataFrame:
    """A-20: (id, type, name, fact_ids): one for each role, mount, collection, path and browser store, numbered in sorted order."""
    roles = fields_of(facts, "role_check", "roles").select("id", F.explode(list_of("roles")).alias("k")).groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("fact_ids"))
    ee = roles.select(F.lit("ExternalEntity").alias("type"), F.lit("EE").alias("p"), F.lit(1).alias("part"), "k", F.concat("k", F.lit(" (actor role)")).alias("name"), "fact_ids")
    mounts = fields_of(facts, "express_mount", "mount_path").groupBy(F.col("mount_path").alias("k")).agg(F.max_by("id", F.struct("pos", "id")).alias("i"))
    own = routes_by_mount(routes(facts))
    p = mounts.join(own, mounts["k"] == own["mount_path"], "left").select(F.lit("Process").alias("type"), F.lit("P").alias("p"), F.lit(1).alias("part"), "k", F.col("k").alias("name"), F.concat(F.array("i"), F.coalesce(F.array_sort("routes"), F.array().cast(_LIST))).alias("fact_ids"))
    store = lambda part, construct, key, name, first=False: fields_of(facts, construct, key).groupBy(F.col(key).alias("k")).agg((F.array(F.min_by("id", F.struct("pos", "file", "line", "id"))) if first else F.array_sort(F.collect_list("id"))).alias("fact_ids")).select(F.lit("DataStore").alias("type"), F.lit("DS").alias("p"), F.lit(part).alias("part"), "k", name.alias("name"), "fact_ids")
    ds = store(1, "mongo_collection", "collection", F.concat(F.lit("MongoDB "), "k", F.lit(" collection")), True)
    ds = ds.unionByName(store(2, "fs_location", "fs_path", F.concat(F.lit("File system ("), "k", F.lit(")")))).unionByName(store(3, "web_storage_access", "store", F.concat(F.lit("Browser "), "k")))
    both = ee.unionByName(p).unionByName(ds)
    n = F.row_number().over(Window.partitionBy("p").orderBy("part", "k"))
    return both.select(F.concat("p", n.cast("string")).alias("id"), "type", "name", "fact_ids", "part", F.col("k").alias("key"))


def implied_flows(facts: DataFrame, parts: DataFrame) -> DataFrame:
    """A-21, J-20: (id, source, destination, intent, description, fact_ids), one for each (source, destination, intent).

    Role checks give requests and, on a GET, responses; accesses to a collection reads and writes; uploads writes to the
    paths of the uploader's module, or of the same file where the module isn't known. The first description is kept,
    facts are in the order of their arrival: role checks, accesses, uploads, each by file, line and id.
    """
    table = routes(facts).select(F.col("id").alias("route_fact_id"), F.col("mount_path").alias("_mount"), F.col("method").alias("_method"))
    of = lambda kind, part, name: parts.where((F.col("type") == kind) & (F.col("part") == part)).select(F.col("key").alias(name), F.col("id").alias(f"{name}_id"))
    process, role, coll, path = of("Process", 1, "_mount"), of("ExternalEntity", 1, "role"), of("DataStore", 1, "collection"), of("DataStore", 2, "fs_path")
    place = lambda construct, *names: fields_of(facts, construct, "route_fact_id", *names).join(table, "route_fact_id").join(process, "_mount")
    flow = lambda s, d, intent, text, sub=0: F.struct(s.alias("source"), d.alias("destination"), F.lit(intent).alias("intent"), text.alias("description"), F.lit(sub).alias("sub"))
    c = F.col
    arrival = lambda group, k="''": F.struct(F.lit(group).alias("g"), "pos", "file", "line", "id", F.expr(k).cast("string").alias("k"))
    asks = place("role_check", "roles").select("*", F.posexplode(list_of("roles")).alias("_k", "role")).join(role, "role")
    pair = F.array(flow(c("role_id"), c("_mount_id"), "request", F.concat("role", F.lit(" requests "), "_mount")), F.when(c("_method") == "GET", flow(c("_mount_id"), c("role_id"), "response", F.concat("_mount", F.lit(" returns data to "), "role"), 1)))
    # names inside other columns of a select with a generator are lost, so these are made first
    asks = asks.select("id", arrival(1, "lpad(_k, 6, '0')").alias("at"), F.array_compact(pair).alias("pair")).select("id", "at", F.explode("pair").alias("f"))
    access = place("db_access", "collection", "access").join(coll, "collection")
    write = c("access") == "write"
    access = access.select("id", arrival(2).alias("at"), F.when(write, flow(c("_mount_id"), c("collection_id"), "db_write", F.concat("_mount", F.lit(" writes "), "collection"))).otherwise(flow(c("collection_id"), c("_mount_id"), "db_read", F.concat("_mount", F.lit(" reads "), "collection"))).alias("f"))
    uses = place("multer_use", "uploader", "field")
    bound = fields_of(facts, "require_binding", "local_name", "resolved_file").groupBy(c("file").alias("_bf"), c("local_name").alias("_bn")).agg(F.max_by("resolved_file", F.struct("pos", "id")).alias("_to"))
    uses = uses.join(bound, (c("file") == c("_bf")) & (c("uploader") == c("_bn")), "left").withColumn("_from", F.coalesce("_to", "file"))
    where = fields_of(facts, "fs_location", "fs_path").select(c("file").alias("_from"), "fs_path").distinct()
    uses = uses.join(where, "_from").join(path, "fs_path")
    uses = uses.select("id", arrival(3, "fs_path").alias("at"), flow(c("_mount_id"), c("fs_path_id"), "file_write", F.concat_ws("", "_mount", F.lit(" stores uploaded "), F.coalesce("field", F.lit("None")), F.lit(" in "), "fs_path")).alias("f"))
    all_of = asks.unionByName(access).unionByName(uses).select("id", F.struct("at", "f.sub").alias("at"), "f.source", "f.destination", "f.intent", "f.description")
    merged = all_of.groupBy("source", "destination", "intent").agg(F.min_by("description", "at").alias("description"), F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"))
    ids = F.array_distinct(F.transform("ids", lambda x: x["id"]))
    return in_order(merged, "first").select(F.concat(F.lit("DF"), F.col("n").cast("string")).alias("id"), "source", "destination", "intent", "description", ids.alias("fact_ids"))


def rendered(facts: DataFrame, suppressed: tuple[str, ...] = ("module_export",)) -> DataFrame:
    """F-19, P-08: (id, file, line, text): a fact as one line of ``key=value`` pairs; suppressed constructs are left out."""
    shown = F.filter(F.array_sort(F.map_entries("fields")), lambda e: e["value"].isNotNull() & (e["value"] != "[]") & (e["key"] != "from_fact_id"))
    pairs = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "  ")
    where = F.when(F.col("line") > 0, F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
    tail = F.when(F.col("derived"), "  (DERIVED: computed by rule, not present in any source line)").when(F.col("confidence") != "high", F.concat(F.lit("  (confidence: "), "confidence", F.lit(")"))).otherwise("")
    return facts.where(~F.col("construct").isin(*suppressed)).select("id", "file", "line", F.concat(F.lit("["), "id", F.lit("] "), "construct", F.lit(" "), where, F.lit("  "), pairs, tail).alias("text"))


def ranking(rows: DataFrame, combos: DataFrame, weights: DataFrame) -> DataFrame:
    """F-18, J-25: rows with ``computed``: value of (feasibility, difficulty) times the weight of the type, to three places."""
    out = rows.join(combos, ["feasibility", "difficulty"], "left").join(weights, "threat_type", "left")
    return out.withColumn("computed", F.round(F.col("combo") * F.col("weight"), 3)).drop("combo", "weight")


def reconciled(a: DataFrame, b: DataFrame, key: str, texts: list[str], value: str, near: float = 0.005) -> DataFrame:
    """J-23, J-25: rows of ``a`` with ``issues`` against the row of ``b`` with the same key: texts equal, values within ``near``."""
    other = b.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_b_{c}") for c in (*texts, value)))
    out = a.join(other, F.col(key) == F.col("_k"), "left")
    issues = [F.when(F.col("_k").isNull(), F.lit("missing"))] + [F.when(F.col("_k").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(f"{c} differs")) for c in texts]
    issues.append(F.when(F.abs(F.col(value) - F.col(f"_b_{value}")) >= near, F.lit(f"{value} differs")))
    return out.withColumn("issues", F.array_compact(F.array(*issues))).drop("_k", *(f"_b_{c}" for c in (*texts, value)))
