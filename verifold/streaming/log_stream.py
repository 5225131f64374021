"""Structured Streaming over event logs: append, hourly counts, the newest rows of a ring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON files of a folder; lines that don't parse are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def hourly(log: DataFrame, time: str = "logged_at", late: str | None = None) -> DataFrame:
    """Counts by hour and type; on a stream ``late`` says how long to wait for late rows."""
    rows = log.withWatermark(time, late) if late else log
    by = rows.groupBy(F.window(time, "1 hour").alias("w"), "document_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("window_start"), "document_type", "n")


def validate(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Decide on each micro-batch and append; a batch that is run again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        decide(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring(stream: DataFrame, keep: int, path: str, checkpoint: str, order: tuple[str, ...] = ("logged_at", "id")):
    """After each micro-batch a folder with the newest rows; the folder of the batch before is its input."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/ring-{number - 1}"))
        logs.ring(rows, keep, order, least=0).write.mode("overwrite").parquet(f"{path}/ring-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
