"""Sessions with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and splits skewed keys; ANSI mode makes bad casts errors.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "veriframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``settings`` override them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
