"""S-05 to S-10, S-18 to S-20, S-28: diagrams, catalogs, threats, facts and keys as tables; guarded writes."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators.validate import violations
from veriframe.tables import DFD, FACT, GOLD, THREAT


def read_dfds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S-05: (dfd_id, _meta, elements, flows, trust_boundaries), one row a file; unreadable files have null lists."""
    raw = spark.read.schema(DFD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.withColumn("dfd_id", F.input_file_name())


def elements_of(dfds: DataFrame) -> DataFrame:
    """(dfd_id, pos, id, type, name ...)."""
    return dfds.select("dfd_id", F.posexplode("elements").alias("pos", "x")).select("dfd_id", "pos", "x.*")


def flows_of(dfds: DataFrame) -> DataFrame:
    """(dfd_id, pos, id, source, destination ...): parallel flows stay apart."""
    return dfds.select("dfd_id", F.posexplode("flows").alias("pos", "x")).select("dfd_id", "pos", "x.*")


def _rows(spark: SparkSession, path: str, key: str, item: str) -> DataFrame:
    """S-06, S-08: rows of a JSON file that holds a list, bare or under ``key``, with ``pos``; a missing file is an error."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    struct = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in item.split(', '))}>>"
    wrapped, bare = F.from_json("value", f"`{key}` {struct}")[key], F.from_json("value", struct)
    rows = text.select(F.when(F.startswith(F.ltrim("value", F.lit(" \n\r\t")), F.lit("[")), bare).otherwise(wrapped).alias("r"))
    return rows.select(F.posexplode("r").alias("pos", "x")).select("pos", "x.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """S-06: the catalog with ``pos``, the order on which matching depends."""
    return _rows(spark, path, "threats", GOLD)


def read_threats(spark: SparkSession, path: str) -> DataFrame:
    """S-07: generated threats with ``gen_index``; unknown fields are dropped."""
    return _rows(spark, path, "threats", THREAT).withColumnRenamed("pos", "gen_index")


def write_threats(threats: DataFrame, path: str) -> None:
    """S-07: one JSON object a line, in partitions."""
    threats.write.mode("overwrite").json(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """S-08: facts, wrapped or bare; list values in ``fields`` are JSON."""
    return _rows(spark, path, "facts", FACT)


def read_hand_keys(spark: SparkSession, path: str) -> DataFrame:
    """S-09: (element_id, kind, key, implemented); a missing or empty map is an error, as no default could be right."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    m = text.select(F.explode(F.map_entries(F.from_json("value", "elements map<string,struct<kind:string,key:string,implemented:boolean>>")["elements"])).alias("e"))
    out = m.select(F.col("e.key").alias("element_id"), "e.value.kind", F.coalesce("e.value.key", F.lit("")).alias("key"), F.coalesce("e.value.implemented", F.lit(True)).alias("implemented"))
    if out.isEmpty():
        raise ValueError(f"no keys in {path}")
    return out


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """S-10, J-26: (id, name, parent, linddun_types) of activities and sub-activities; absent types are an empty list."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    j = F.from_json("value", "privacy_activities array<struct<id:string,name:string,linddun_types:array<string>,sub_activities:array<struct<id:string,name:string>>>>")
    a = text.select(F.explode(j["privacy_activities"]).alias("a"))
    none = F.array().cast("array<string>")
    own = a.select("a.id", "a.name", F.lit(None).cast("string").alias("parent"), F.coalesce("a.linddun_types", none).alias("linddun_types"))
    sub = a.select(F.explode("a.sub_activities").alias("s"), F.col("a.id").alias("parent"), F.coalesce("a.linddun_types", none).alias("linddun_types"))
    return own.unionByName(sub.select("s.id", "s.name", "parent", "linddun_types"))


def third_party(spark: SparkSession, path: str) -> DataFrame:
    """S-19: (gen_index, from, to, category, nodes) of another tool's export: an array of edge and category findings."""
    finding = "edge struct<from:string,to:string>, category string, source_id string, data_flow_id string, destination_id string"
    raw = spark.read.option("multiLine", True).schema(finding).json(path)
    return raw.select(F.monotonically_increasing_id().alias("gen_index"), F.col("edge.from").alias("from"), F.col("edge.to").alias("to"), "category", F.array("source_id", "data_flow_id", "destination_id").alias("nodes"))


def settings(path: str | None = None) -> dict[str, str]:
    """S-18: settings of an environment file under the real environment; an empty value is an absent one."""
    out: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path) as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    out |= {k: v for k, v in os.environ.items() if k in out or v}
    return {k: v for k, v in out.items() if v}


def code_version(folder: str = ".") -> str:
    """S-28: the commit that the code is at, with ``+`` if it is changed; ``unknown`` outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    head = git("rev-parse", "--short", "HEAD")
    return head.stdout.strip() + "+" * bool(git("status", "--porcelain").stdout.strip()) if head.returncode == 0 else "unknown"


def emit(dfds: DataFrame, path: str) -> None:
    """S-20: writes diagrams to a derived scenario's folder, after validation, with the current version and a fixed order of keys."""
    if not any(p.endswith("_derived") for p in path.rstrip("/").split("/")):
        raise ValueError(f"{path} is not a derived scenario's folder")
    bad = violations(dfds)
    if found := bad.limit(20).collect():
        raise ValueError("\n".join(f"{r['rule']} {r['where']}: {r['message']}" for r in found))
    meta = F.coalesce("_meta", F.struct(F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("int").alias("schema_version")))
    dfds.select(F.struct(meta["scenario"].alias("scenario"), F.lit(2).alias("schema_version")).alias("_meta"), "elements", "flows", "trust_boundaries").write.mode("overwrite").json(path)
