"""The process log as a stream. An addition: the batch operators do the same over files at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import upsert


def tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON lines of a folder, as they come."""
    return spark.readStream.schema(schema).json(folder)


def events_per_window(log: DataFrame, at: str = "ts", kind: str = "event", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n): counts by time of event; rows later than `late` are left out, so state is bounded."""
    w = F.window(at, window)
    return log.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, at: str):
    """Keep the latest row of each key in a table: each micro-batch writes a new version and names it when whole."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/version={number - 1}"
        old = spark.read.parquet(before) if number else batch.limit(0)
        upsert(old, batch, key, F.col(at)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
