"""Cuboids: aggregates of a measure over dimensions, kept sparse (absent cell = 0), as DataFrames.

Dimensions are columns; a query bit set becomes a packed cell index (``idx``) only where a dense array is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most query bits for a dense answer.
DENSE_BITS = 24


def base_cuboid(rows: DataFrame, dims: Sequence[str], measure: str = "measure", count: str | None = "cnt") -> DataFrame:
    """Sum (and number of rows) by all dimensions."""
    aggs = [F.sum(measure).alias("measure")]
    if count:
        aggs.append((F.sum(count) if count in rows.columns else F.count("*")).alias("cnt"))
    return rows.groupBy(*dims).agg(*aggs)


def project(cuboid: DataFrame, dims: Sequence[str | Column], measures: Sequence[str] = ("measure",), keep_zero: bool = True) -> DataFrame:
    """Re-aggregates to fewer dimensions (columns or expressions on them); zero cells go unless they are kept."""
    out = cuboid.groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])
    return out if keep_zero else drop_zero(out, measures[0])


def drop_zero(df: DataFrame, measure: str = "measure") -> DataFrame:
    return df.where(F.col(measure) != 0)


def merged(a: DataFrame, b: DataFrame, dims: Sequence[str], measures: Sequence[str] = ("measure", "cnt")) -> DataFrame:
    """A cuboid with the rows of another added: sums merge."""
    cols = [*dims, *measures]
    return a.select(*cols).unionByName(b.select(*cols)).groupBy(*dims).agg(*[F.sum(m).alias(m) for m in measures])


def cells(df: DataFrame, bits: Sequence[Column], measure: str = "measure") -> DataFrame:
    """(idx, measure): the sum for each value of the query bits, sparse. bits[i] is a column of 0 and 1."""
    idx = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        idx = idx + F.shiftleft(b.cast("long"), i)
    return df.groupBy(idx.alias("idx")).agg(F.sum(measure).alias("measure"))


def densify(sparse: DataFrame, q: int, measure: str = "measure") -> DataFrame:
    """All 2**q cells; absent ones are 0."""
    if q > DENSE_BITS:
        raise ValueError(f"{q} bits are too many for a dense answer")
    spark = sparse.sparkSession
    every = spark.range(1 << q).withColumnRenamed("id", "idx")
    return every.join(sparse, "idx", "left").select("idx", F.coalesce(measure, F.lit(0)).alias(measure))


def dense_array(sparse: DataFrame, q: int, measure: str = "measure") -> np.ndarray:
    """The dense array on the driver: at most 2**q values leave the cluster."""
    if q > DENSE_BITS:
        raise ValueError(f"{q} bits are too many for a dense answer")
    out = np.zeros(1 << q)
    for r in sparse.select("idx", measure).toLocalIterator():
        out[r[0]] = r[1] or 0
    return out


def slice_cells(df: DataFrame, fixed: dict[int, int], q: int) -> DataFrame:
    """Cells of a (idx, measure) answer where bit b has value fixed[b]; the index is packed over the remaining bits."""
    keep = F.lit(True)
    for b, v in fixed.items():
        keep = keep & (F.shiftright("idx", b).bitwiseAND(F.lit(1)) == v)
    rest = [b for b in range(q) if b not in fixed]
    idx = F.lit(0).cast("long")
    for i, b in enumerate(rest):
        idx = idx + F.shiftleft(F.shiftright("idx", b).bitwiseAND(F.lit(1)), i)
    return df.where(keep).select(idx.alias("idx"), "measure")


def dice_cells(df: DataFrame, bits: Sequence[int], values: Sequence[int], q: int) -> DataFrame:
    """Sums over several values of the ``bits`` (packed in their order); the index is over the remaining bits."""
    packed = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        packed = packed + F.shiftleft(F.shiftright("idx", b).bitwiseAND(F.lit(1)), i)
    rest = [b for b in range(q) if b not in set(bits)]
    idx = F.lit(0).cast("long")
    for i, b in enumerate(rest):
        idx = idx + F.shiftleft(F.shiftright("idx", b).bitwiseAND(F.lit(1)), i)
    return df.where(packed.isin(*values)).groupBy(idx.alias("idx")).agg(F.sum("measure").alias("measure"))


def all_subsets(df: DataFrame, dims: Sequence[str], measure: str = "measure") -> DataFrame:
    """The sums of every subset of the dimensions in one job; ``gid`` has bit i set where dims[i] is rolled up."""
    flags = sum((F.grouping(d).cast("int") * (1 << i) for i, d in enumerate(dims)), F.lit(0))
    return df.cube(*dims).agg(F.sum(measure).alias("measure"), flags.alias("gid"))


def chosen_subsets(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], measure: str = "measure") -> DataFrame:
    """The sums of the chosen subsets in one job."""
    flags = sum((F.grouping(d).cast("int") * (1 << i) for i, d in enumerate(dims)), F.lit(0))
    return df.groupingSets([list(s) for s in sets], *dims).agg(F.sum(measure).alias("measure"), flags.alias("gid"))


def aligned(low: int, high: int) -> tuple[int, int]:
    """(k, value) so that codes low..high are those with code >> k == value; an error if they aren't such a range."""
    n = high - low + 1
    if n <= 0 or n & (n - 1) or low % n:
        raise ValueError(f"codes {low}..{high} aren't aligned to a power of two")
    k = n.bit_length() - 1
    return k, low >> k


def in_range(code: Column, low: int, high: int) -> Column:
    """An aligned range, as bounds that a Parquet reader can use; an error if it isn't aligned."""
    aligned(low, high)
    return code.between(low, high)
