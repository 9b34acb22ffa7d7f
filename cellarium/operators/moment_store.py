"""Stored moments: (mask, value) of all subsets of a set of bits up to a size, for answers without any cuboid."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.bits import to_mask
from cellarium.operators.cube import Cube

from cellarium.solvers.extrapolate import CoMoment
from cellarium.solvers.moments import values

def build(cube: Cube, bits: Sequence[int], most: int) -> DataFrame:
    """(mask, value): the sum of the rows that have all bits of the mask, for every subset of at most ``most`` bits.

    Each row gives a value to the subsets of its own bits only; sums combine before the shuffle. At most 62 bits."""
    bits = sorted(bits)
    sets = [s for k in range(most + 1) for s in itertools.combinations(range(len(bits)), k)]
    own = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        own = own + F.shiftleft(cube.bit_column(b).cast("long"), i)
    rows = cube.base.groupBy(own.alias("own")).agg(F.sum("measure").alias("measure"))
    masks = F.array(*[F.lit(to_mask(s)).cast("long") for s in sets])
    return rows.select(F.explode(F.filter(masks, lambda m: m.bitwiseAND(F.col("own")) == m)).alias("mask"), "measure").groupBy("mask").agg(F.sum("measure").cast("long").alias("value"))

def save(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)

def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

def relevant(store: DataFrame, mask: int) -> DataFrame:
    """The moments of a query's subsets: a filter on the mask."""
    return store.where(F.col("mask").bitwiseAND(F.lit(~mask)) == 0)

def solve(store: DataFrame, positions: Sequence[int], most: int) -> np.ndarray:
    """A query's cells from a store of subsets of at most ``most`` bits; central moments of larger ones are 0.

    positions: the query's bits in the store. A moment that isn't stored is a sum over no rows."""
    q, full = len(positions), to_mask(positions)
    at = {p: i for i, p in enumerate(positions)}
    known = {}
    for r in relevant(store, full).toLocalIterator():
        known[to_mask([at[p] for p in positions if r["mask"] >> p & 1])] = float(r["value"])
    s = CoMoment(q, (known.get(0, 0.0), [known.get(1 << i, 0.0) for i in range(q)]), handle_negative=True)
    for mask in (m for m in range(1, 1 << q) if m.bit_count() <= most):
        own = [i for i in range(q) if mask >> i & 1]
        sub = np.array([known.get(to_mask([own[j] for j in range(len(own)) if t >> j & 1]), 0.0) for t in range(1 << len(own))])
        s.add(mask, values(sub))
    return s.solve()
