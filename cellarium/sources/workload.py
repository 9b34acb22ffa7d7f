"""Query workloads: random or prefix queries of given sizes, saved with their true answers."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.cube import Cube
from cellarium.plans.strategies import prefix_sample


def generate(cube: Cube, sizes: Sequence[int], per_size: int, prefix: bool = True, seed: int = 0) -> list[tuple[int, ...]]:
    rng = random.Random(seed)
    columns = [cube.column_bits(c) for c in cube.columns]
    return [prefix_sample(rng, columns, q) if prefix else tuple(sorted(rng.sample(range(cube.n_bits), q))) for q in sizes for _ in range(per_size)]


def true_results(cube: Cube, queries: Sequence[Sequence[int]]) -> DataFrame:
    """(query, idx, measure): sparse exact answers of all queries in one job over the base cuboid."""
    def idx(q):
        out = F.lit(0).cast("long")
        for i, b in enumerate(sorted(q)):
            out = out + F.shiftleft(cube.bit_column(b).cast("long"), i)
        return out

    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("query"), idx(q).alias("idx")) for i, q in enumerate(queries)])).alias("x")
    return cube.base.select(tagged, "measure").groupBy("x.query", "x.idx").agg(F.sum("measure").cast("long").alias("measure"))


def save(results: DataFrame, path: str, queries: Sequence[Sequence[int]] = ()) -> None:
    """The true answers, and the queries they belong to."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    rows = [(i, list(q)) for i, q in enumerate(queries)]
    results.sparkSession.createDataFrame(rows, "query int, bits array<int>").write.mode("overwrite").parquet(f"{path}/queries")


def load(spark: SparkSession, path: str) -> tuple[list[tuple[int, ...]], DataFrame]:
    """(queries, their true answers)."""
    rows = spark.read.parquet(f"{path}/queries").orderBy("query").collect()  # as many as the workload has
    return [tuple(r["bits"]) for r in rows], spark.read.parquet(f"{path}/results")
