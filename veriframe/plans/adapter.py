"""From code facts to a scored diagram: extract (outside), resolve, derive, verify, align, score; and enrichment.

Each phase is written before the next reads it, as each is read several times; plans stay small and a lost executor
costs one phase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions.logic import rate
from veriframe.operators import accept, align, facts

MARKER = " [code: "


def _kept(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def cites(ids: str = "fact_ids") -> F.Column:
    """Provenance entries of a list of fact ids."""
    return F.transform(ids, lambda x: F.struct(x.alias("fact_id"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("array<int>").alias("bbox"), F.lit(None).cast("string").alias("label_text")))


@dataclass
class Derived:
    facts: DataFrame
    elements: DataFrame
    flows: DataFrame


def derive(spark: SparkSession, extracted: DataFrame, folder: str) -> Derived:
    """E-10, A-20, A-21: resolved facts, elements and flows below ``folder``."""
    known = _kept(spark, facts.resolved(extracted), folder, "facts")
    parts = _kept(spark, facts.elements(known), folder, "elements")
    flows = _kept(spark, facts.implied_flows(known, parts), folder, "flows")
    return Derived(known, parts.select("id", "type", "name", cites().alias("provenance"), "key"), flows.select("id", "source", "destination", "description", "intent", cites().alias("provenance")))


def verify(derived: Derived, reextracted: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row of rates (A-07) over the elements' and flows' checks; unrun checks are in no rate."""
    e = accept.verify_items(derived.elements, derived.facts, reextracted, files)
    f = accept.evidence_links(derived.flows, derived.elements, derived.facts)
    one = e.agg(*(rate(F.col(c)).alias(f"element_{c}") for c in ("citations_resolvable", "evidence_type_consistent", "facts_present", "all_valid")))
    two = f.agg(rate(F.col("endpoints_declared")).alias("flow_endpoints_declared"), rate(F.col("evidence_connects")).alias("flow_evidence_connects"), rate(F.col("direction_matches")).alias("flow_direction_matches"))
    return one.crossJoin(two)


def score(spark: SparkSession, derived: Derived, hand_keys: DataFrame, hand_flows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J-15, J-16, A-10, A-11, Z-21: derivability of elements and of flows, and the adapter's own figures."""
    keys = align.element_keys(derived.elements, derived.facts)
    el = _kept(spark, align.align_elements(keys, hand_keys), folder, "element_alignment")
    fl = _kept(spark, align.align_flows(derived.flows, hand_flows, el), folder, "flow_alignment")
    return align.element_derivability(hand_keys, el), align.flow_derivability(hand_flows, hand_keys, fl), align.adapter_scores(derived.elements, derived.flows, el, fl)


def enrich(flows: DataFrame, elements: DataFrame, known: DataFrame) -> DataFrame:
    """J-28, P-13: flows whose description ends in the facts that share their tokens; structure and provenance stay."""
    names = elements.select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    text = flows.join(names.toDF("_s", "_sn"), F.col("source") == F.col("_s"), "left").join(names.toDF("_d", "_dn"), F.col("destination") == F.col("_d"), "left")
    text = text.select("id", F.concat_ws(" ", "_sn", "_dn", "description").alias("context"))
    words = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    best = accept.attach_facts(text, known.select("id", F.concat_ws(" ", "construct", "file", words).alias("text")))
    phrases = best.join(known.select(F.col("id").alias("fact"), accept.fact_phrase().alias("phrase")), "fact")
    order = F.array_sort(F.collect_list(F.struct("rank", "phrase", "fact")))
    note = phrases.groupBy("flow_id").agg(F.array_join(F.transform(order, lambda x: x["phrase"]), "; ").alias("note"), F.transform(order, lambda x: x["fact"]).alias("fact_ids"))
    out = flows.join(note, F.col("id") == F.col("flow_id"), "left")
    return out.withColumn("description", F.when(F.col("note").isNotNull(), F.concat(F.coalesce("description", F.lit("")), F.lit(MARKER), "note", F.lit("]"))).otherwise(F.col("description"))).drop("flow_id", "note")
