"""V-1 to V-14: every violation of a diagram's contract, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.tables import ELEMENT_TYPES

VERSIONS = (1, 2)


def _rows(df: DataFrame, rule: str, where: Column, message: Column | str, bad: Column) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.coalesce(bad, F.lit(False))).select("dfd_id", F.lit(rule).alias("rule"), where.alias("where"), text.alias("message"))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _listed(dfds: DataFrame, name: str) -> DataFrame:
    return dfds.select("dfd_id", F.posexplode(name).alias("n", "x")).select("dfd_id", "n", "x.*")


def _provenance(rows: DataFrame, where: Column) -> DataFrame:
    """V-7: each citation names one vocabulary, and a box has four numbers."""
    p = rows.select("dfd_id", where.alias("w"), F.posexplode("provenance").alias("i", "p"))
    at = F.concat("w", F.lit(": provenance["), F.col("i").cast("string"), F.lit("]"))
    n = F.col("p.fact_id").isNotNull().cast("int") + (F.col("p.file").isNotNull() & F.col("p.line").isNotNull()).cast("int") + F.col("p.bbox").isNotNull().cast("int")
    box = F.col("p.bbox").isNotNull() & ((F.size("p.bbox") != 4) | F.exists("p.bbox", lambda v: v.isNull()))
    return _rows(p, "V-7", at, "more than one vocabulary", n > 1).unionByName(_rows(p, "V-7", at, "no vocabulary", n == 0)).unionByName(_rows(p, "V-7", at, "bbox is not four ints", box))


def _repeats(rows: DataFrame, rule: str, where: Column, what: str) -> DataFrame:
    """Missing ids, and each further row of an id."""
    n = F.row_number().over(Window.partitionBy("dfd_id", "id").orderBy("n"))
    numbered = rows.withColumn("_again", n)
    return _rows(rows, rule, where, f"missing {what} id", _blank("id")).unionByName(_rows(numbered, rule, where, f"duplicate {what} id", ~_blank("id") & (F.col("_again") > 1)))


def _undeclared(refs: DataFrame, declared: DataFrame, rule: str, message: str) -> DataFrame:
    """refs: (dfd_id, w, ref)."""
    return refs.join(declared.select("dfd_id", F.col("id").alias("ref")).distinct(), ["dfd_id", "ref"], "left_anti").select("dfd_id", F.lit(rule).alias("rule"), F.col("w").alias("where"), F.concat(F.lit(message), F.col("ref")).alias("message"))


def violations(dfds: DataFrame) -> DataFrame:
    """(dfd_id, rule, where, message) of all violations of diagrams (dfd_id, _meta, elements, flows, trust_boundaries).

    Elements without a flow are none. A diagram that could not be parsed has null lists (V-1, V-3).
    """
    at = lambda kind: F.concat(F.lit(f"{kind}["), F.col("n").cast("string"), F.lit("] ("), F.coalesce("id", F.lit("")), F.lit(")"))
    whole = F.lit("")
    version = F.coalesce("_meta.schema_version", F.lit(1))
    e, f = _listed(dfds, "elements"), _listed(dfds, "flows")
    t = _listed(dfds, "trust_boundaries")
    ids = e.where(~_blank("id"))
    out = [
        _rows(dfds, "V-1", whole, "top level must be an object", F.col("elements").isNull() & F.col("flows").isNull() & F.col("_meta").isNull()),
        _rows(dfds, "V-2", whole, F.concat(F.lit("schema_version "), version.cast("string")), ~version.isin(*VERSIONS)),
        _rows(dfds, "V-3", whole, "'elements' must be a list", F.col("elements").isNull()),
        _rows(dfds, "V-3", whole, "'flows' must be a list", F.col("flows").isNull()),
        _repeats(e, "V-4", at("elements"), "element"),
        _rows(e, "V-5", at("elements"), F.concat(F.lit("type "), F.coalesce("type", F.lit("null"))), ~F.coalesce(F.col("type").isin(*ELEMENT_TYPES), F.lit(False))),
        _rows(e, "V-6", at("elements"), "missing or empty 'name'", _blank("name")),
        _provenance(e, at("elements")),
        _provenance(f, at("flows")),
        _repeats(f, "V-8", at("flows"), "flow"),
        _rows(f, "V-10", at("flows"), "missing or empty 'description'", _blank("description")),
        _repeats(t, "V-11", at("trust_boundaries"), "trust boundary"),
        _rows(t, "V-11", at("trust_boundaries"), "missing or empty 'name'", _blank("name")),
        _undeclared(t.select("dfd_id", at("trust_boundaries").alias("w"), F.explode("contains").alias("ref")), ids, "V-12", "contains undeclared "),
        _undeclared(e.where(~_blank("trust_boundary")).select("dfd_id", at("elements").alias("w"), F.col("trust_boundary").alias("ref")), t, "V-13", "undeclared trust boundary "),
        _undeclared(f.select("dfd_id", at("flows").alias("w"), F.explode("crosses_boundaries").alias("ref")), t, "V-14", "crosses undeclared "),
    ]
    for end in ("source", "destination"):
        out.append(_rows(f, "V-9", at("flows"), f"missing '{end}'", _blank(end)))
        out.append(_undeclared(f.where(~_blank(end)).select("dfd_id", at("flows").alias("w"), F.col(end).alias("ref")), ids, "V-9", f"{end} undeclared "))
    all_of = out[0]
    for x in out[1:]:
        all_of = all_of.unionByName(x)
    return all_of
