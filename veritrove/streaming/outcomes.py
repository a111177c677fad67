"""Incremental scoring: outcomes of answers as they arrive, and their counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OUTCOMES


def counted(events: DataFrame, time: str = "ts", config: str = "config", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each outcome by config and window; state ends `late` after a window does."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), config).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES])


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: a batch that runs again replaces its own part."""
    batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def run(scored: DataFrame, path: str, checkpoint: str):
    """Appends finished rows with a checkpoint, so that a run resumes where it stopped."""
    return scored.writeStream.foreachBatch(lambda b, i: append_once(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
