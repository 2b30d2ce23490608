"""Pages and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: States in which a producer has ended (fixed values); what it saved before it broke off counts too.
TERMINAL = ("done", "error", "skipped", "partial")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def page_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Page rows as producers write them, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def stage_windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean_ms): counts per window; events later than ``late`` no longer count."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_ms")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_ms")


def new_pages(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages without re-delivered ones (same ``page_row_id``) within the watermark on ``ingested_at``."""
    return pages.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["page_row_id"])


def unfinished(pages: DataFrame, finished: DataFrame) -> DataFrame:
    """Arriving pages that no earlier run has finished; ``finished`` is a table, read anew with every batch."""
    return pages.join(finished.select("document_id", "page_index").distinct(), ["document_id", "page_index"], "left_anti")


def ready(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Arriving pages whose run has ended in any way; ``runs`` (run_id, status) is a table."""
    return pages.join(runs.where(F.col("status").isin(*TERMINAL)).select("run_id", "status"), "run_id")


def latest_progress(progress: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The latest progress row per key as a running state; ``at`` is the event time."""
    rest = [c for c in progress.columns if c not in keys]
    return progress.withWatermark(at, late).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_x")).select(*keys, "_x.*")


def snapshots(rows: DataFrame, path: str, *by: str) -> DataStreamWriter:
    """Each batch overwrites just the partitions that it brings, so a reader always sees whole snapshots."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    return rows.writeStream.foreachBatch(write)


def detected(pages: DataFrame, dictionary: Callable[[], DataFrame], find: Callable[[DataFrame, DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Spans of arriving pages, appended; ``dictionary`` is called for every batch, so what people mark meanwhile counts."""

    def write(batch: DataFrame, number: int) -> None:
        find(batch, dictionary()).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return pages.writeStream.foreachBatch(write)
