"""Synthetic rows: random cubes, log-normal cells, sampled columns, value functions. Seeded and distributed."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_cube(spark: SparkSession, n_bits: int, rows_log2: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """2**rows_log2 random keys of n_bits bits (distinct ones if not ``replace``), each with measure 1."""
    if n_bits > 62:
        raise ValueError("a packed key has 62 bits at most")
    if replace:
        key = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << n_bits))
    else:  # an odd factor and xor shifts permute the keys
        if rows_log2 > n_bits:
            raise ValueError("there are fewer keys than rows")
        mask = F.lit((1 << n_bits) - 1)
        key = F.col("id")
        for factor in (0x9E3779B1, 0x85EBCA77):
            key = (key.bitwiseXOR(F.shiftright(key, max(1, n_bits // 2))) * F.lit(factor % (1 << 30) | 1) + F.lit(seed)).bitwiseAND(mask) if n_bits <= 32 else key.bitwiseXOR(F.lit(seed)).bitwiseAND(mask)
    return spark.range(1 << rows_log2).select(key.cast("long").alias("key"), F.lit(1).cast("long").alias("measure"))


def micro_bench(spark: SparkSession, n_bits: int, p: float = 0.3, stddev: float = 0.5, total: float = 1e6, seed: int = 0) -> DataFrame:
    """Every cell of n_bits bits: a product distribution with a share p of each bit's ones, times log-normal noise."""
    value = F.lit(float(total))
    for b in range(n_bits):
        value = value * F.when(F.shiftright("id", b).bitwiseAND(F.lit(1)) == 1, F.lit(p)).otherwise(F.lit(1 - p))
    return spark.range(1 << n_bits).select(F.col("id").alias("idx"), F.floor(value * F.exp(F.randn(seed) * stddev)).cast("long").alias("measure"))


def uniform(n: int, seed: int = 0) -> Column:
    return F.floor(F.rand(seed) * n).cast("int")


def half_gaussian(n: int, seed: int = 0) -> Column:
    """Skewed to small codes."""
    return F.least(F.floor(F.abs(F.randn(seed)) * n / 4), F.lit(n - 1)).cast("int")


def random_walk(spark: SparkSession, n: int, rows: int, seed: int = 0) -> DataFrame:
    """(Time, code): steps of -1, 0 or 1, the sum folded into 0..n-1 by reflection. Steps are summed in ranges of rows first."""
    step = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) - 1
    part = 10_000
    steps = spark.range(rows).select("id", step.alias("s"), F.floor(F.col("id") / part).alias("p"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = steps.groupBy("p").agg(F.sum("s").alias("t")).select("p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("b"))
    at = F.pmod(F.sum("s").over(Window.partitionBy("p").orderBy("id")) + F.col("b"), F.lit(2 * n))
    return steps.join(starts, "p").withColumn("at", at).select(F.col("id").alias("Time"), F.when(F.col("at") < n, F.col("at")).otherwise(2 * n - 1 - F.col("at")).cast("int").alias("code"))


def random_value(low: int, high: int, seed: int = 0) -> Callable[[Column], Column]:
    """A whole number from low to high by the row's time."""
    return lambda t: (F.pmod(F.xxhash64(t, F.lit(seed)), F.lit(high - low + 1)) + low).cast("long")


def trend(time: Column, n: int, rows: int, seed: int = 0) -> Column:
    """Codes that rise with the row's time, give or take."""
    return F.least(F.greatest(F.floor(time * n / rows + F.randn(seed) * n / 20), F.lit(0)), F.lit(n - 1)).cast("int")


def tuples(spark: SparkSession, rows: int, columns: dict[str, Callable[[Column], Column]], partitions: int | None = None) -> DataFrame:
    """Rows whose columns come from functions of the row number (``Time``)."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return base.select(F.col("id").alias("Time"), *[f(F.col("id")).alias(c) for c, f in columns.items()])


def constant(v: int) -> Callable[[Column], Column]:
    return lambda t: F.lit(v).cast("long")


def linear(a: float, b: float) -> Callable[[Column], Column]:
    return lambda t: F.floor(t * a + b).cast("long")


def sine(amplitude: float, period: float, shift: float = 0.0) -> Callable[[Column], Column]:
    return lambda t: F.floor(F.sin(t * (2 * 3.141592653589793 / period) + shift) * amplitude + 0.5).cast("long")


def mapped(f: Callable[[Column], Column], g: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: g(f(t))


def summed(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def out(t: Column) -> Column:
        total = fs[0](t)
        for f in fs[1:]:
            total = total + f(t)
        return total

    return out


#: Values of generated fields by their type.
TYPED: dict[str, Callable[[random.Random], object]] = {
    "int": lambda r: r.randrange(100),
    "double": lambda r: round(r.uniform(-1000, 1000), 3),
    "bool": lambda r: r.random() < 0.5,
    "text": lambda r: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))),
    "date": lambda r: f"{r.randint(1990, 2025)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    "phone": lambda r: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(0, 9999):04d}",
    "url": lambda r: f"https://{''.join(r.choice('abcdefghij') for _ in range(6))}.example.org/{r.randrange(1000)}",
    "list": lambda r: [r.randrange(10) for _ in range(r.randint(0, 3))],
    "object": lambda r: {"a": r.randrange(10), "b": r.choice("xyz")},
}


def drifting_records(n: int, fields: Sequence[str], seed: int = 0, p: float = 1 / 15, types: dict[str, str] | None = None) -> list[dict]:
    """Records whose schema drifts: before each one a field may be added, removed or renamed, each with probability p.

    types: the kind of each field's values (``int`` without one); a new field's kind is drawn, a renamed one keeps its own."""
    r = random.Random(seed)
    live, fresh, out = list(fields), 0, []
    kind = {f: (types or {}).get(f, "int") for f in fields}
    for i in range(n):
        if r.random() < p:
            live.append(f"new{fresh}")
            kind[live[-1]] = r.choice(sorted(TYPED)) if types else "int"
            fresh += 1
        if len(live) > 1 and r.random() < p:
            live.pop(r.randrange(len(live)))
        if r.random() < p:
            k = r.randrange(len(live))
            was = live[k]
            live[k] = f"{was.split('~')[0]}~{fresh}"
            kind[live[k]] = kind[was]
            fresh += 1
        out.append({"row": i} | {f: TYPED[kind[f]](r) for f in live})
    return out
