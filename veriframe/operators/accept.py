"""P-08 to P-14, J-17 to J-19, J-34, W-09, A-26, A-27, N2, N5: accepting and checking what a model wrote.

A check that could not run is null; it is neither a pass nor a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.logic import verdict
from veriframe.functions.text import enrich_tokens, phrase_of
from veriframe.operators.align import cited
from veriframe.operators.facts import fields_of, routes
from veriframe.tables import ELEMENT_TYPES, SUPPORTING

_IDS = "array<string>"


def _ids(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_IDS))


def _judged(raw: DataFrame, problem: Column, key: str = "id") -> DataFrame:
    """Rows with ``status`` (kept or rejected) and ``reason``; of rows without a problem the first of an id is kept (N5)."""
    out = raw.withColumn("reason", problem)
    first = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy("pos"))
    out = out.withColumn("_n", first)
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "duplicate"))).withColumn("status", F.when(F.col("reason").isNull(), "kept").otherwise("rejected")).drop("_n")


def with_resolved(raw: DataFrame, facts: DataFrame, column: str = "fact_ids") -> DataFrame:
    """Rows with ``cited_ids`` and ``bogus_ids``: which of the cited ids the vocabulary has, in order."""
    c = raw.select("pos", F.posexplode(_ids(column)).alias("_n", "_f")).join(facts.select(F.col("id").alias("_f"), F.lit(True).alias("_ok")).distinct(), "_f", "left")
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("_n", "_f")))), lambda x: x["_f"])
    got = c.groupBy("pos").agg(pick(F.col("_ok").isNotNull()).alias("cited_ids"), pick(F.col("_ok").isNull()).alias("bogus_ids"))
    return raw.join(got, "pos", "left").withColumn("cited_ids", _ids("cited_ids")).withColumn("bogus_ids", _ids("bogus_ids"))


def accept_elements(raw: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """P-09; without facts P-11: the first well-formed element of each id that cites a known fact; ids that don't resolve are noted."""
    bad = F.when(F.coalesce("id", F.lit("")) == "", "malformed").when(~F.coalesce(F.col("type").isin(*ELEMENT_TYPES), F.lit(False)), "malformed").when(F.coalesce("name", F.lit("")) == "", "malformed")
    if facts is None:
        return _judged(raw, bad)
    out = with_resolved(raw, facts)
    out = _judged(out, F.coalesce(bad, F.when(F.size("cited_ids") == 0, "cites no resolvable fact")))
    note = F.concat(F.lit("[adapter: dropped unresolvable fact ids "), F.array_join("bogus_ids", ", "), F.lit("]"))
    return out.withColumn("uncertainty_note", F.when((F.col("status") == "kept") & (F.size("bogus_ids") > 0), F.trim(F.concat_ws(" ", F.col("uncertainty_note") if "uncertainty_note" in raw.columns else F.lit(None).cast("string"), note))).otherwise(F.col("uncertainty_note") if "uncertainty_note" in raw.columns else F.lit(None).cast("string")))


def accept_flows(raw: DataFrame, kept_elements: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """P-10; without facts P-11: the first flow of each id whose end points were kept and that cites a known fact; a default description."""
    e = kept_elements.select(F.col("id").alias("_e")).distinct()
    out = raw if facts is None else with_resolved(raw, facts)
    out = out.join(e.toDF("_s"), F.col("source") == F.col("_s"), "left").join(e.toDF("_d"), F.col("destination") == F.col("_d"), "left")
    bad = F.when(F.coalesce("id", F.lit("")) == "", "missing id").when(F.col("_s").isNull() | F.col("_d").isNull(), "endpoint not an emitted element")
    if facts is not None:
        bad = F.coalesce(bad, F.when(F.size("cited_ids") == 0, "cites no resolvable fact"))
    text = F.coalesce(F.nullif("description", F.lit("")), F.concat("source", F.lit(" -> "), "destination"))
    return _judged(out, bad).withColumn("description", text).drop("_s", "_d")


def clean_citations(citations: Column) -> Column:
    """P-12: of structs (file, line as text) those with a file and a whole number, trimmed and typed."""
    fine = F.filter(citations, lambda c: (F.coalesce(F.trim(c["file"]), F.lit("")) != "") & c["line"].try_cast("int").isNotNull())
    return F.coalesce(F.transform(fine, lambda c: F.struct(F.trim(c["file"]).alias("file"), c["line"].try_cast("int").alias("line"))), F.array().cast("array<struct<file:string,line:int>>"))


def accept_enrichments(raw: DataFrame, flows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """P-13: the first note of each flow that exists; with facts it must cite one, without them no citation drops a note."""
    out = raw if facts is None else with_resolved(raw, facts)
    out = out.join(flows.select(F.col("id").alias("_f")).distinct(), F.col("flow_id") == F.col("_f"), "left")
    bad = F.when(F.col("_f").isNull(), "not a flow in this DFD").when(F.trim(F.coalesce("data_note", F.lit(""))) == "", "empty data_note")
    if facts is not None:
        bad = F.coalesce(bad, F.when(F.size("cited_ids") == 0, "cites no resolvable fact"))
    return _judged(out, bad, "flow_id").withColumn("data_note", F.trim("data_note")).drop("_f")


def attach_facts(flows: DataFrame, facts: DataFrame, most: int = 4, least: int = 2) -> DataFrame:
    """J-28, O-04: (flow_id, rank, fact, overlap): facts that share ``least`` tokens with a flow's text, the best ``most``, ties by id.

    flows: (id, context). facts: (id, text). An equi-join on tokens; pairs that share none are never made.
    """
    f = flows.select(F.col("id").alias("flow_id"), F.explode(enrich_tokens("context")).alias("token"))
    t = facts.select(F.col("id").alias("fact"), F.explode(enrich_tokens("text")).alias("token"))
    n = f.join(t, "token").groupBy("flow_id", "fact").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("flow_id").orderBy(F.desc("overlap"), "fact"))).where(F.col("rank") <= most)


def fact_phrase(construct: str = "construct", fields: str = "fields") -> Column:
    """F-15, F-19: a fact as ``construct(key=value, ...)`` of at most 110 signs."""
    shown = F.filter(F.array_sort(F.map_entries(fields)), lambda e: e["value"].isNotNull() & (e["value"] != "[]") & (e["key"] != "from_fact_id"))
    inner = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return phrase_of(F.when(inner == "", F.col(construct)).otherwise(F.concat(F.col(construct), F.lit("("), inner, F.lit(")"))))


def budget_fill(files: DataFrame, by: list[str], order: str, size: str, most: int) -> DataFrame:
    """W-09: files with ``taken``: in order, each that still fits into ``most``; a later smaller one may fit.

    Each choice depends on all before it, so a group is walked in its order, in one task; its rows pass through sorted, and
    only the room that is left is remembered. A file without a size takes none.
    """
    rows = files.select(*by, order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_s"))
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left = object(), 0
        for b in batches:
            taken = []
            for *key, s in zip(*(b.column(i).to_pylist() for i in (*range(n), n + 1))):
                if key != group:
                    group, left = key, most
                taken.append(s <= left)
                left -= s if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(taken, pa.bool_())], names=[*by, order, "taken"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, order))
    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, f"{kinds}, taken boolean")


def location_check(citations: DataFrame, files: DataFrame) -> DataFrame:
    """J-18: citations (file, line) with ``status``: ok, unknown_file or out_of_range, by the files' n_lines."""
    n = files.select(F.col("doc").alias("_f"), F.col("n_lines").alias("_n"))
    status = F.when(F.col("_n").isNull(), "unknown_file").when(F.col("line").between(1, F.col("_n")), "ok").otherwise("out_of_range")
    return citations.join(n, F.col("file") == F.col("_f"), "left").withColumn("status", status).drop("_f", "_n")


def open_validity(checked: DataFrame, *by: str) -> DataFrame:
    """A-27: citations by status, and the share that resolves; null if nothing was cited."""
    s = F.col("status")
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(s == "ok").alias("n_resolvable"), F.count_if(s == "unknown_file").alias("n_unknown_file"), F.count_if(s == "out_of_range").alias("n_line_out_of_range"), F.round(F.avg((s == "ok").cast("int")), 4).alias("validity"))


def verify_items(items: DataFrame, facts: DataFrame, reextracted: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """J-14, J-17, J-18, E-12: elements with citations_resolvable, evidence_type_consistent, facts_present and all_valid.

    reextracted: facts of the source as it is now; files: its (doc, n_lines). Without them open citations and presence
    are unchecked (null). Derived facts need no re-extraction.
    """
    p = items.select(F.col("id").alias("item"), F.explode("provenance").alias("p"))
    known = facts.select(F.col("id").alias("_f"), F.col("construct").alias("_c"), F.col("file").alias("_ff"), F.col("line").alias("_fl"), F.col("derived").alias("_der"))
    ids = p.where("p.fact_id is not null").join(known, F.col("p.fact_id") == F.col("_f"), "left")
    opens = p.where("p.fact_id is null and p.file is not null and p.line is not null").select("item", F.col("p.file").alias("file"), F.col("p.line").alias("line"))
    by_id = ids.groupBy("item").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("_f").isNull()).alias("bad_ids"))
    out = items.join(by_id, items["id"] == by_id["item"], "left").drop("item")
    n_open = opens.groupBy("item").agg(F.count(F.lit(1)).alias("n_open"))
    out = out.join(n_open, out["id"] == n_open["item"], "left").drop("item")
    zero = lambda c: F.coalesce(c, F.lit(0))
    unchecked = (zero("n_open") > 0) & F.lit(files is None or reextracted is None)
    if files is not None:
        bad = location_check(opens, files).groupBy("item").agg(F.count_if(F.col("status") != "ok").alias("bad_open"))
        out = out.join(bad, out["id"] == bad["item"], "left").drop("item")
    else:
        out = out.withColumn("bad_open", F.lit(0))
    resolvable = F.when(~unchecked, (zero("n_ids") + zero("n_open") > 0) & (zero("bad_ids") == 0) & (zero("bad_open") == 0))
    vocabulary = facts if reextracted is None else facts.unionByName(reextracted.select(*facts.columns)).dropDuplicates(["id"])
    c = cited(items, vocabulary).join(items.select(F.col("id").alias("item"), "type"), "item")
    support = F.lit(False)
    for t, cs in SUPPORTING.items():
        support = support | ((F.col("type") == t) & F.col("construct").isin(*cs))
    ev = c.groupBy("item").agg(F.bool_or(support).alias("_ev"))
    out = out.join(ev, out["id"] == ev["item"], "left").drop("item")
    if reextracted is None:
        out = out.withColumn("facts_present", F.lit(None).cast("boolean"))
    else:
        there = reextracted.select(F.col("construct").alias("_c"), F.col("file").alias("_ff"), F.col("line").alias("_fl")).distinct()
        gone = ids.where("_f is not null and not _der").join(there, ["_c", "_ff", "_fl"], "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("_g1"))
        bare = opens.join(reextracted.select("file", "line").distinct(), ["file", "line"], "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("_g2"))
        out = out.join(gone, out["id"] == gone["item"], "left").drop("item")
        out = out.join(bare, out["id"] == bare["item"], "left").drop("item")
        out = out.withColumn("facts_present", (zero("_g1") == 0) & (zero("_g2") == 0)).drop("_g1", "_g2")
    out = out.withColumn("citations_resolvable", resolvable).withColumn("evidence_type_consistent", F.when(~unchecked, F.coalesce("_ev", F.lit(False)))).drop("_ev", "n_ids", "bad_ids", "n_open", "bad_open")
    return out.withColumn("all_valid", verdict(F.col("citations_resolvable"), F.col("evidence_type_consistent"), F.col("facts_present")))


def evidence_links(flows: DataFrame, elements: DataFrame, facts: DataFrame) -> DataFrame:
    """J-19: (id, endpoints_declared, evidence_connects, direction_matches) of flows, by the facts that flow and end points cite.

    Any of: an access whose route belongs to one end and whose collection to the other (whichever way); a route binding
    or role check of the process end; an upload or path where the store end has a path or collection; a browser store of
    the store end. direction_matches: whether the first connecting access moves data the arrow's way; null without one.
    """
    table = routes(facts).select(F.col("id").alias("route"), F.col("mount_path").alias("mount"))
    of = cited(elements, facts)
    f = lambda n: F.try_element_at("fields", F.lit(n))
    stores = of.select(F.col("item").alias("e"), F.explode(F.array_compact(F.array(F.nullif(f("collection"), F.lit("")), F.nullif(f("fs_path"), F.lit("")), F.when(F.col("construct") == "web_storage_access", f("store"))))).alias("store")).distinct()
    own = of.where("construct = 'express_route'").select(F.col("item").alias("e"), F.col("fact").alias("route"))
    by_mount = of.where("construct = 'express_mount'").select(F.col("item").alias("e"), f("mount_path").alias("mount")).join(table, "mount").select("e", "route")
    covers = own.unionByName(by_mount).distinct()
    kinds = elements.select(F.col("id").alias("_i"), F.col("type").alias("_t"))
    fl = flows.join(kinds.toDF("_si", "_st"), F.col("source") == F.col("_si"), "left").join(kinds.toDF("_di", "_dt"), F.col("destination") == F.col("_di"), "left")
    fl = fl.withColumn("endpoints_declared", F.col("_si").isNotNull() & F.col("_di").isNotNull())
    ends = fl.where("endpoints_declared").select(F.col("id").alias("item"), "source", "destination", "_st", "_dt")
    ev = cited(flows, facts).join(ends, "item").select("item", "n", "construct", "source", "destination", "_st", "_dt", f("route_fact_id").alias("route"), f("collection").alias("coll"), f("access").alias("access"), f("store").alias("bstore"))
    hits = []
    access = ev.where("construct = 'db_access'")
    for proc, store, forward in (("source", "destination", True), ("destination", "source", False)):
        hit = access.join(covers.toDF(proc, "route"), [proc, "route"], "left_semi").join(stores.toDF(store, "coll"), [store, "coll"], "left_semi")
        hits.append(hit.select("item", "n", F.lit(0 if forward else 1).alias("o"), (F.lit(forward) == (F.col("access") == "write")).alias("dir")))
    bind = ev.where("construct in ('http_route_binding', 'role_check')").withColumn("e", F.when(F.col("_dt") == "Process", F.col("destination")).otherwise(F.col("source")))
    hits.append(bind.join(covers, ["e", "route"], "left_semi").select("item", "n", F.lit(2).alias("o"), F.lit(None).cast("boolean").alias("dir")))
    put = ev.withColumn("e", F.when(F.col("_dt") == "DataStore", F.col("destination")).otherwise(F.col("source")))
    hits.append(put.where("construct in ('multer_use', 'fs_location', 'express_static_mount', 'fs_write')").join(stores.select("e").distinct(), "e", "left_semi").select("item", "n", F.lit(2).alias("o"), F.lit(None).cast("boolean").alias("dir")))
    hits.append(put.where("construct = 'web_storage_access'").join(stores.toDF("e", "bstore"), ["e", "bstore"], "left_semi").select("item", "n", F.lit(2).alias("o"), F.lit(None).cast("boolean").alias("dir")))
    both = hits[0]
    for h in hits[1:]:
        both = both.unionByName(h)
    first = both.groupBy("item").agg(F.min_by("dir", F.struct("n", "o")).alias("direction_matches"))
    out = fl.join(first.withColumn("_hit", F.lit(True)), fl["id"] == first["item"], "left")
    return out.select("id", "endpoints_declared", (F.col("endpoints_declared") & F.coalesce("_hit", F.lit(False))).alias("evidence_connects"), "direction_matches")


def enrichment_violations(before: DataFrame, after: DataFrame, elements_before: DataFrame, elements_after: DataFrame, facts: DataFrame) -> DataFrame:
    """J-34, T-06: (id, problem) of each way in which enriched flows break their contract.

    Flows: (id, source, destination, description, provenance) and, after, fact_ids. Elements are compared whole.
    """
    names = sorted(set(elements_before.columns) & set(elements_after.columns))
    row = lambda df: df.select(F.to_json(F.struct(*names)).alias("j"))
    changed = row(elements_before).exceptAll(row(elements_after)).unionByName(row(elements_after).exceptAll(row(elements_before))).limit(1)
    out = changed.select(F.lit("elements").alias("id"), F.lit("elements changed").alias("problem"))
    b = before.select(F.col("id").alias("i"), *(F.col(c).alias(f"b_{c}") for c in ("source", "destination", "description", "provenance")))
    a = after.select(F.col("id").alias("k"), *(F.col(c).alias(f"a_{c}") for c in ("source", "destination", "description", "provenance", "fact_ids")))
    j = b.join(a, F.col("i") == F.col("k"), "full")
    e = F.lit("")
    problems = F.array_compact(
        F.array(
            F.when(F.col("i").isNull() | F.col("k").isNull(), "flow id set changed"),
            F.when(F.col("i").isNotNull() & F.col("k").isNotNull() & ~(F.col("b_source").eqNullSafe(F.col("a_source")) & F.col("b_destination").eqNullSafe(F.col("a_destination"))), "endpoints changed"),
            F.when(F.col("i").isNotNull() & F.col("k").isNotNull() & ~F.startswith(F.coalesce("a_description", e), F.coalesce("b_description", e)), "original description not preserved as prefix"),
            F.when(F.col("i").isNotNull() & F.col("k").isNotNull() & ~F.to_json(F.struct("b_provenance")).eqNullSafe(F.replace(F.to_json(F.struct("a_provenance")), F.lit("a_provenance"), F.lit("b_provenance"))), "provenance changed"),
            F.when(F.exists(F.coalesce("a_provenance", F.array().cast(after.schema["provenance"].dataType)), lambda p: p["fact_id"].isNotNull()), "fact_id in provenance"),
        )
    )
    out = out.unionByName(j.select(F.coalesce("i", "k").alias("id"), F.explode(problems).alias("problem")))
    stray = after.select("id", F.explode(_ids("fact_ids")).alias("f")).join(facts.select(F.col("id").alias("f")).distinct(), "f", "left_anti")
    return out.unionByName(stray.select("id", F.concat(F.lit("enrichment cites unresolvable fact id "), "f").alias("problem")))


def description_growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """A-26: mean description length before and after, and the number of flows enriched."""
    n = lambda df, c: df.agg(F.avg(F.length(F.coalesce("description", F.lit("")))).alias(c))
    return n(before, "mean_before").crossJoin(n(after, "mean_after")).crossJoin(after.agg(F.count_if(F.size(_ids("fact_ids")) > 0).alias("n_enriched")))


def files_of(facts: DataFrame) -> DataFrame:
    """Z-09: the largest line that facts name in each file."""
    return facts.groupBy(F.col("file").alias("doc")).agg(F.max("line").alias("n_lines"))


def upload_targets(facts: DataFrame) -> DataFrame:
    """J-20: (id, fs_path): the paths that an upload's module, or else its own file, writes to."""
    uses = fields_of(facts, "multer_use", "uploader")
    bound = fields_of(facts, "require_binding", "local_name", "resolved_file").groupBy(F.col("file").alias("_bf"), F.col("local_name").alias("_bn")).agg(F.max_by("resolved_file", F.struct("pos", "id")).alias("_to"))
    uses = uses.join(bound, (F.col("file") == F.col("_bf")) & (F.col("uploader") == F.col("_bn")), "left").withColumn("_from", F.coalesce("_to", "file"))
    return uses.join(fields_of(facts, "fs_location", "fs_path").select(F.col("file").alias("_from"), "fs_path").distinct(), "_from").select("id", "fs_path")
