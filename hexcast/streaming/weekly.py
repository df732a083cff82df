"""Streaming forms of the weekly rollup, and sessions, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """A file-drop stream with event time as TIMESTAMP (watermarks do not take TIMESTAMP_NTZ)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly(events: DataFrame, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Sum and count by Monday-aligned week; works on batches and, with a watermark, on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    week = F.window("ts", "7 days", "7 days", "4 days").alias("w")
    out = rows.groupBy(*keys, week).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.to_date("w.start").alias("monday"), "total", "n")


def sessions(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Activity sessions of a key: start, end and events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that has arrived and return its result, kept as files in the shared folder `path`.

    In complete mode each micro-batch is the whole result and replaces the one before; else it is added.
    """
    spark = stream.sparkSession
    how = "overwrite" if mode == "complete" else "append"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)
    query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(how).parquet(path))
    query.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def published_view(path: str, replace: list[str], x: str, y: str, key: str, measures: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that publishes a new version in which a micro-batch's groups (columns `replace`) take the place of the old ones.

    Readers keep the version that they pinned while the next is written. The micro-batch's number is the version's token, so one
    that is replayed after a failure is published once. Rows of groups that the micro-batch does not touch are carried over.
    """
    from hexcast.sources import snapshots

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        token, known = f"batch-{number}", snapshots.versions(spark, path)
        if known:
            latest = snapshots.snapshot(spark, path, known[-1])
            if latest.token == token:
                return
            touched = batch.select(*replace).distinct()
            batch = batch.unionByName(snapshots.read(spark, latest).join(touched, replace, "left_anti").select(*batch.columns))
        snapshots.publish(batch, path, x, y, key, measures, token=token)

    return write
