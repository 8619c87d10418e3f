"""X-01 to X-04 as Structured Streaming, and event windows.

The windows are an extension: timestamps occur in no operator of the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriframe.sources.runs import append_state


def cells(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def resumable(stream: DataFrame, process: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """X-01, X-02, S-24: processes cells once: each micro-batch adds the rows whose keys the state lacks.

    The checkpoint remembers the files; the keys make a batch that is run again harmless.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_state(process(batch), state, keys)).start()


def windows(events: DataFrame, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, kind, n, total) of event-time windows, tumbling or sliding; rows later than ``late`` are dropped by a stream."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", every, slide) if slide else F.window("_t", every)
    return e.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(start, end, user, n) of sessions that a gap ends."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.session_window("_t", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
