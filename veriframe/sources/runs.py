"""S-16, S-17, S-21 to S-24, A-31, J-29, P-15, P-16, X-01, X-02, Z-01, Z-02: runs on disk, their reports and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.text import condition_parts
from veriframe.operators.metrics import run_stats


def discover(paths: DataFrame, root: str = "", path: str = "path") -> DataFrame:
    """S-16, O-09: (scenario, condition, run, file, input, arm, model) of paths ``scenario/condition/run<n>/file``; others are left out."""
    below = F.col(path) if not root else F.element_at(F.split(F.col(path), F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"([\[\](){}.*+?^$|\\])", r"\\$1")), -1)
    parts = F.split(below, "/")
    run = F.regexp_extract(F.try_element_at(parts, F.lit(3)), r"^run(\d+)$", 1).try_cast("int")
    out = paths.withColumn("_p", parts).withColumn("run", run).where((F.size("_p") == 4) & F.col("run").isNotNull())
    out = out.select("*", F.col("_p")[0].alias("scenario"), F.col("_p")[1].alias("condition"), F.col("_p")[3].alias("file")).drop("_p")
    return out.withColumn("_c", condition_parts("condition")).select("*", "_c.input", "_c.arm", "_c.model").drop("_c")


def next_run(found: DataFrame, *by: str) -> DataFrame:
    """A-31: the number after the largest."""
    return found.groupBy(*by).agg((F.coalesce(F.max("run"), F.lit(0)) + 1).alias("next_run"))


def parse_report(text: str | Column) -> list[Column]:
    """S-17, P-15: the figures of a text report: the ALL row, citation rate, counts, and whether its gold anchors nothing."""
    t = F.col(text) if isinstance(text, str) else text
    row = lambda i, kind: F.regexp_extract(t, r"(?m)^ALL\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)", i).try_cast(kind)
    one = lambda p, kind: F.regexp_extract(t, p, 1).try_cast(kind)
    gold, lost = one(r"n_gold=(\d+)", "int"), one(r"(?m)^\s+unresolved_location\s+(\d+)", "int")
    return [
        row(1, "int").alias("tp"), row(2, "int").alias("fp"), row(3, "int").alias("fn"), row(4, "double").alias("precision"), row(5, "double").alias("recall"), row(6, "double").alias("f1"),
        one(r"(?m)^\s+all_valid_rate\s+([\d.]+)", "double").alias("citation_all_valid"), one(r"n_generated=(\d+)", "int").alias("n_generated"), gold.alias("n_gold"),
        F.coalesce((gold > 0) & (lost >= gold), F.lit(False)).alias("unscorable"),
    ]


def read_reports(spark: SparkSession, folder: str, glob: str = "*_eval.txt") -> DataFrame:
    """S-17: (path, tp ...) of all reports below a folder; texts without an ALL row are left out."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), *parse_report("value")).where("tp is not null")


def summary(reports: DataFrame, *by: str) -> DataFrame:
    """S-23, P-15: mean and sd of each figure by condition; scores leave out unscorable runs, citations and volume don't."""
    good = reports.withColumns({c: F.when(~F.col("unscorable"), F.col(c)) for c in ("precision", "recall", "f1")})
    out = None
    for c in ("precision", "recall", "f1", "citation_all_valid", "n_generated"):
        s = run_stats(good.withColumn(c, F.col(c).cast("double")), list(by), c).select(*by, F.col("n").alias(f"{c}_n"), F.col("mean").alias(f"{c}_mean"), F.col("sd").alias(f"{c}_sd"))
        out = s if out is None else out.join(s, list(by))
    return out.join(reports.groupBy(*by).agg(F.count_if("unscorable").alias("unscorable_runs")), list(by))


def only_ok(rows: DataFrame, status: str = "status") -> DataFrame:
    """P-16: rows whose status is ok, or absent."""
    return rows.where(F.coalesce(status, F.lit("ok")) == "ok")


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """S-24, X-01: planned cells that are not in the state yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def topped_up(existing: DataFrame, candidates: DataFrame, n: int | None = None, seed: int = 42, key: str = "gen_index") -> DataFrame:
    """S-21, X-02, O-06: the worklist with its labels, and new rows up to ``n`` in all (None: all), in the order of a seeded hash.

    The sample is by MD5 of seed and key, so a larger ``n`` only adds rows.
    """
    fresh = candidates.join(existing.select(key), key, "left_anti")
    if n is not None:
        own = existing.join(candidates.select(key), key, "left_semi").count()
        fresh = fresh.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(max(0, n - own))
    return existing.unionByName(fresh, allowMissingColumns=True)


def append_state(rows: DataFrame, path: str, keys: list[str]) -> None:
    """S-24: adds rows whose keys the state at ``path`` lacks; a repeated call adds nothing."""
    spark = rows.sparkSession
    try:
        rows = pending(rows, spark.read.parquet(path), keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    rows.withColumn("_n", first).where("_n = 1").drop("_n").write.mode("append").parquet(path)


def scenario_of(name: str | Column) -> Column:
    """Z-02: a scenario's name without the mark of a derived one."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, "_derived$", "")


def report(counts: DataFrame) -> DataFrame:
    """S-22: scored counts as fixed-width lines, the total last; figures are in the columns, this is a view of them.

    Widths are the least: a longer name or count is written whole and moves what follows.
    """
    line = F.format_string("%-10s %5d %5d %5d %9.2f %6.2f %6.2f", "category", *(F.col(c).cast("bigint") for c in ("tp", "fp", "fn")), "precision", "recall", "f1")
    return counts.select((F.col("category") == "ALL").alias("last"), "category", line.alias("line")).orderBy("last", "category").select("line")
