"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.storage import scratch

#: Rows that one task sorts.
RANK_ROWS = 500_000
#: Most parts of a ranking, hence rows of the table of their starts.
RANK_PARTS = 20_000


def ranked(df: DataFrame, order: Sequence[str | Column], name: str, rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``name``: the row's number from 0 in the global order.

    Rows are dealt by ranges that Spark samples from all of ``order``, so equal first columns don't meet in one task; each
    part is sorted and written once (its rows can't change places afterwards), and the parts' starts are sums of counts.
    """
    spark = df.sparkSession
    parts = max(1, min(RANK_PARTS, df.count() // rows))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    path = scratch(spark, "ranked")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftrightunsigned("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, here.cast("long")).drop("_at", "_part", "_start")
