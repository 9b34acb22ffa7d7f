"""Micro-batch ingestion into a base cuboid, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(stream: DataFrame, dims: dict[str, Column], measure: Column, path: str, checkpoint: str) -> None:
    """Folds all available batches of a stream into partial cuboids under ``path``: one folder a batch.

    A batch that runs again after a failure overwrites its own folder, so each row counts once. Sums merge on reading.
    """
    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[c.alias(n) for n, c in dims.items()], measure.alias("measure"))
        part = rows.groupBy(*dims).agg(F.sum("measure").alias("measure"), F.count("*").alias("cnt"))
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def base(spark: SparkSession, path: str, dims: Sequence[str]) -> DataFrame:
    """The base cuboid of all batches so far."""
    return spark.read.parquet(path).groupBy(*dims).agg(F.sum("measure").cast("long").alias("measure"), F.sum("cnt").cast("long").alias("cnt"))


def compact(spark: SparkSession, path: str, dims: Sequence[str], to: str) -> DataFrame:
    """Rewrites the batches as one cuboid."""
    base(spark, path, dims).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
