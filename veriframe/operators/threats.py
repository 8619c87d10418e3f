"""J-01 to J-04, J-32, A-09, A-10, P-01 to P-07, N4, R-09: threats against a diagram and the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators.matching import first_by, located

NO_ROW = "No mapping-table row for this interaction."


def with_endpoints(flows: DataFrame, elements: DataFrame, how: str = "left") -> DataFrame:
    """J-01, Z-06: flows with their end points' names and types; left keeps flows whose end points are not declared."""
    e = elements.select(F.col("id").alias("_i"), F.col("name").alias("_n"), F.col("type").alias("_t"))
    s, d = (e.select(*(F.col(c).alias(c + x) for c in ("_i", "_n", "_t"))) for x in "sd")
    out = flows.join(s, F.col("source") == F.col("_is"), how).join(d, F.col("destination") == F.col("_id"), how)
    return out.withColumnsRenamed({"_ns": "source_name", "_ts": "source_type", "_nd": "dest_name", "_td": "dest_type"}).drop("_is", "_id")


def contexts(interactions: DataFrame, mapping: DataFrame, invalid: DataFrame, source: str = "source_type", dest: str = "dest_type") -> DataFrame:
    """J-02: interactions with ``valid``, ``note`` and ``applicable`` (map of threat type to positions).

    The list of invalid pairs goes before the mapping; a pair in neither is invalid with a note. Both dimensions are as
    small as there are pairs of element types.
    """
    pairs = mapping.groupBy(F.col("source_type").alias("_s"), F.col("dest_type").alias("_d"), "threat_type").agg(F.collect_list("position").alias("p")).groupBy("_s", "_d").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat_type", "p")))).alias("_a"))
    bad = invalid.groupBy(F.col("source").alias("_is"), F.col("destination").alias("_id")).agg(F.first("reason").alias("_r"))
    out = interactions.join(F.broadcast(bad), (F.col(source) == F.col("_is")) & (F.col(dest) == F.col("_id")), "left").join(F.broadcast(pairs), (F.col(source) == F.col("_s")) & (F.col(dest) == F.col("_d")), "left")
    valid = F.col("_r").isNull() & F.col("_a").isNotNull()
    return out.withColumn("valid", valid).withColumn("note", F.when(valid, "").otherwise(F.coalesce("_r", F.lit(NO_ROW)))).withColumn("applicable", F.when(valid, F.col("_a"))).drop("_is", "_id", "_r", "_s", "_d", "_a")


def context_nodes(contexts_: DataFrame, tree_nodes: DataFrame, *by: str) -> DataFrame:
    """J-03, R-09: the tree nodes of each context's applicable types: (by, threat_type, positions, node_id, title, description)."""
    each = contexts_.where("valid").select(*by, F.explode("applicable").alias("threat_type", "positions"))
    return each.join(tree_nodes.select("threat_type", "node_id", "title", "description"), "threat_type")


def gated(flows: DataFrame, mapping: DataFrame, invalid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-06: flows whose interaction can carry a threat, and the skipped ones with the reason in ``note``."""
    c = contexts(flows, mapping, invalid)
    return c.where("valid"), c.where("not valid")


def chosen_flows(flows: DataFrame, ids: list[str] | None) -> DataFrame:
    """P-07: the flows of a list of ids; an id that no flow has is an error."""
    if ids is None:
        return flows
    have = {r["id"] for r in flows.where(F.col("id").isin(*ids)).select("id").distinct().collect()}
    if missing := sorted(set(ids) - have):
        raise ValueError(f"unknown flow ids: {missing}")
    return flows.where(F.col("id").isin(*ids))


def mode(rag: bool = False, ungrounded: bool = False, framework: str = "linddun") -> str:
    """P-04: the generation mode that flags name; two that exclude each other are an error."""
    if rag and ungrounded:
        raise ValueError("rag and ungrounded exclude each other")
    own = "rag" if rag else "ungrounded" if ungrounded else "grounded"
    if framework not in ("linddun", "panoptic"):
        raise ValueError(f"unknown framework {framework!r}")
    return own if framework == "linddun" else {"grounded": "panoptic"}.get(own, f"panoptic_{own}")


def known_fields(threats: DataFrame) -> DataFrame:
    """P-03: known columns only; a missing mode follows ``grounded``."""
    from veriframe.tables import THREAT

    names = [x.split()[0] for x in THREAT.split(", ")]
    have = [c for c in names if c in threats.columns]
    out = threats.select(*(["gen_index"] if "gen_index" in threats.columns else []), *have)
    if "mode" in have and "grounded" in have:
        out = out.withColumn("mode", F.coalesce("mode", F.when(F.col("grounded"), "grounded").otherwise("ungrounded")))
    return out


def flow_query(source_name: str = "source_name", dest_name: str = "dest_name", description: str = "description") -> Column:
    """P-01: the retrieval query of a flow: its end points' names and its description."""
    return F.concat(F.col(source_name), F.lit(" -> "), F.col(dest_name), F.lit(": "), F.coalesce(description, F.lit("")))


def prompts(flows: DataFrame, blocks: DataFrame | None, instructions: str, flow: str = "id") -> DataFrame:
    """P-02, F-25, Z-23: (flow, prompt, prompt_sha256, prompt_chars): instructions, the flow and its context blocks in order.

    blocks: (flow, pos, block). The text depends on the rows alone, so its digest is comparable between runs.
    """
    head = flows.select(F.col(flow).alias("flow"), F.concat_ws("\n", F.lit(instructions), F.concat(F.lit("Flow "), F.col(flow), F.lit(": "), F.col("source_name"), F.lit(" ("), F.col("source_type"), F.lit(") -> "), F.col("dest_name"), F.lit(" ("), F.col("dest_type"), F.lit(")")), F.col("description")).alias("head"))
    if blocks is not None:
        b = blocks.groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n").alias("context"))
        head = head.join(b, "flow", "left")
    else:
        head = head.withColumn("context", F.lit(None).cast("string"))
    text = F.concat_ws("\n\n", "head", "context")
    return head.select("flow", text.alias("prompt"), F.sha2(text, 256).alias("prompt_sha256"), F.length(text).alias("prompt_chars"))


def well_formed(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """P-14: rows with all required fields, and one row that counts the malformed ones; none is fatal."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return rows.where(ok), rows.agg(F.count_if(~ok).alias("malformed"), F.count(F.lit(1)).alias("rows"))


def verified(threats: DataFrame, elements: DataFrame, flows: DataFrame, tree_nodes: DataFrame, mapping: DataFrame, invalid: DataFrame) -> DataFrame:
    """J-04, N4: threats with node_valid, type_applicable, location_valid, position_applicable (null: not cited) and reasons.

    A threat without a position (made before the field was) has the lenient location rule: its originator is any
    element or an end of the flow. With one, the originator must be the very place that the position names.
    """
    nodes = tree_nodes.select(F.col("threat_type").alias("_tt"), F.col("node_id").alias("_nn")).distinct()
    t = threats.join(nodes, (F.col("threat_type") == F.col("_tt")) & (F.col("tree_node") == F.col("_nn")), "left").withColumn("node_valid", F.col("_nn").isNotNull()).drop("_tt", "_nn")
    f = with_endpoints(first_by(flows.select("id", "source", "destination", "pos"), ["id"], ["pos"]), elements)
    f = contexts(f, mapping, invalid).select(F.col("id").alias("_f"), F.col("source").alias("_s"), F.col("destination").alias("_d"), F.col("source_type").alias("_st"), F.col("dest_type").alias("_dt"), F.col("valid").alias("_v"), F.col("applicable").alias("_a"))
    own = elements.select(F.col("id").alias("_e")).distinct()
    t = t.join(f, F.col("flow_id") == F.col("_f"), "left").join(own, F.col("originator_id") == F.col("_e"), "left")
    there = F.col("_f").isNotNull()
    ends = F.col("_st").isNotNull() & F.col("_dt").isNotNull()
    position = F.trim(F.coalesce("position", F.lit("")))
    allowed = F.try_element_at("_a", "threat_type")
    context = there & ends & F.coalesce("_v", F.lit(False))
    kind = F.coalesce(context & allowed.isNotNull(), F.lit(False))
    expected = F.when(position == "S", F.col("_s")).when(position == "D", F.col("_d")).when(position == "fl", F.col("_f"))
    place = F.when(~there, F.lit(False)).when(position == "", F.coalesce(F.col("_e").isNotNull() | F.col("originator_id").isin(F.col("_s"), F.col("_d")), F.lit(False))).otherwise(F.coalesce(F.col("originator_id") == expected, F.lit(False)))
    applicable = F.when(there & (position != "") & context, F.coalesce(F.array_contains(allowed, position), F.lit(False)))
    missing = F.concat(F.lit("flow_id '"), F.col("flow_id"), F.lit("' not found"))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("node_valid"), F.concat_ws("", F.lit("tree_node '"), F.col("tree_node"), F.lit("' not under type '"), F.col("threat_type"), F.lit("'"))),
            F.when(~there, missing),
            F.when(there & ends & ~kind, F.concat_ws("", F.lit("threat_type '"), F.col("threat_type"), F.lit("' not applicable at "), F.col("_st"), F.lit("->"), F.col("_dt"))),
            F.when(~there, missing),
            F.when(there & ~place & (position == ""), F.concat_ws("", F.lit("originator_id '"), F.col("originator_id"), F.lit("' not found"))),
            F.when(there & ~place & (position != "") & expected.isNull(), F.concat(F.lit("position '"), position, F.lit("' is not one of S, fl, D"))),
            F.when(there & ~place & expected.isNotNull(), F.concat_ws("", F.lit("position '"), position, F.lit("' names '"), expected, F.lit("', not '"), F.col("originator_id"), F.lit("'"))),
            F.when(applicable.eqNullSafe(False), F.concat(F.lit("position '"), position, F.lit("' not applicable for '"), F.col("threat_type"), F.lit("'"))),
        )
    )
    out = t.withColumn("type_applicable", kind).withColumn("location_valid", place).withColumn("position_applicable", applicable).withColumn("reasons", reasons)
    return out.drop("_f", "_s", "_d", "_st", "_dt", "_v", "_a", "_e")


def reachability(gold: DataFrame, elements: DataFrame, flows: DataFrame, mapping: DataFrame, invalid: DataFrame, matched: DataFrame | None = None, framework: str = "linddun") -> DataFrame:
    """J-32: gold rows with ``class``: matched, reachable_but_missed, structurally_unreachable or unresolved_location.

    The second framework has no invalid interactions, so none of its rows is unreachable.
    """
    g = located(gold, flows)
    f = with_endpoints(first_by(flows.select("id", "source", "destination", "pos"), ["id"], ["pos"]), elements)
    f = contexts(f, mapping, invalid).select(F.col("id").alias("_f"), F.col("source_type").alias("_st"), F.col("dest_type").alias("_dt"), F.col("valid").alias("_v"))
    g = g.join(f, F.col("flow") == F.col("_f"), "left")
    if matched is not None:
        g = g.join(matched.select(F.col("gold_id").alias("_m")).distinct(), F.col("id") == F.col("_m"), "left")
    else:
        g = g.withColumn("_m", F.lit(None))
    known = F.col("_f").isNotNull()
    if framework == "linddun":
        kind = F.when(~known | F.col("_st").isNull() | F.col("_dt").isNull(), "unresolved_location").when(F.col("_v"), "reachable_but_missed").otherwise("structurally_unreachable")
    else:
        kind = F.when(known, "reachable_but_missed").otherwise("unresolved_location")
    return g.withColumn("class", F.when(F.col("_m").isNotNull(), "matched").otherwise(kind)).drop("_f", "_st", "_dt", "_v", "_m")


def breakdown(classified: DataFrame, *by: str) -> DataFrame:
    """A-09: counts of each class, recall over all and over what could be reached."""
    c = F.col("class")
    n = classified.groupBy(*by).agg(*(F.count_if(c == v).alias(v) for v in ("matched", "reachable_but_missed", "structurally_unreachable", "unresolved_location")))
    from veriframe.functions.logic import ratio

    return n.withColumn("raw_recall", ratio(F.col("matched"), F.col("matched") + F.col("reachable_but_missed") + F.col("structurally_unreachable") + F.col("unresolved_location"))).withColumn("reachable_recall", ratio(F.col("matched"), F.col("matched") + F.col("reachable_but_missed")))


def anchorable(gold: DataFrame, flows: DataFrame) -> DataFrame:
    """P-17: gold rows that resolve to a flow of this diagram."""
    return located(gold, flows).where("flow is not null").drop("cited", "convention")
