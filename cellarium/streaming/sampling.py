"""Progressive sampling: prefixes of the base cuboid in a shuffled order that every run repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.operators.cuboid import DENSE_BITS, cells, dense_array

GROUP_ROWS = 64


def shuffled(base: DataFrame, dims: Sequence[str], seed: int = 0) -> DataFrame:
    """Adds ``place`` in [0, 1): the order of a shuffle by the hash of the keys. No sort: a prefix is a filter."""
    h = F.pmod(F.xxhash64(*dims, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return base.withColumn("place", h)


def prefix(rows: DataFrame, share: float) -> DataFrame:
    return rows.where(F.col("place") < share)


def group(rows: DataFrame, n_rows: int, w: int, size: int = GROUP_ROWS) -> DataFrame:
    """The w-th group of about ``size`` rows."""
    parts = max(1, n_rows // size)
    return rows.where(F.floor(F.col("place") * parts) == w)


def naive(base: DataFrame, dims: Sequence[str], bits: Sequence[Column], share: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """(cells of the sample, scale N / m)."""
    rows = shuffled(base, dims, seed)
    n, m = rows.agg(F.count("*"), F.sum(F.when(F.col("place") < share, 1).otherwise(0))).first()
    x = dense_array(cells(prefix(rows, share), bits), len(bits))
    return x, (n / m if m else 0.0)


def online(base: DataFrame, dims: Sequence[str], bits: Sequence[Column], seed: int = 0, first: int = GROUP_ROWS) -> Iterator[tuple[float, np.ndarray]]:
    """(share seen, scaled cells) for samples of about 64, 128, 256, ... rows, until all rows are in.

    One job: sums by cell and by the step at which a row comes in, at most 2**q cells a step."""
    q, n = len(bits), base.count()
    if q > DENSE_BITS:
        raise ValueError(f"{q} bits are too many for a dense answer")
    steps = max(0, int(np.ceil(np.log2(max(1, n) / first))))
    step = F.least(F.greatest(F.ceil(F.log2(F.col("place") * n / first)), F.lit(0)), F.lit(steps)).cast("int")
    idx = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        idx = idx + F.shiftleft(b.cast("long"), i)
    sums = shuffled(base, dims, seed).groupBy(step.alias("step"), idx.alias("idx")).agg(F.sum("measure").alias("measure"), F.count("*").alias("rows"))
    cells_of, rows_of = np.zeros((steps + 1, 1 << q)), np.zeros(steps + 1)
    for r in sums.toLocalIterator():
        cells_of[r["step"], r["idx"]] += r["measure"] or 0
        rows_of[r["step"]] += r["rows"]
    x, m = np.cumsum(cells_of, axis=0), np.cumsum(rows_of)
    for k in range(steps + 1):
        if m[k]:
            yield m[k] / n, x[k] * (n / m[k])
