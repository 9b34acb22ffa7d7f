"""What users do with a query's rows: windows, statistics, trends, criteria, existence, labels, pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.ranking import RANK_ROWS, ranked


def window_rows(df: DataFrame, dim: str, gap: int, value: str = "measure", by: Sequence[str] = ()) -> DataFrame:
    """``window_sum``: the row and the gap - 1 rows after it, in the order of dim. Without ``by`` rows get their global
    numbers first and are then dealt by ranges of these."""
    if not by:
        return _ahead(ranked(df, [dim], "_i"), "_i", gap - 1, value).drop("_i")
    w = Window.partitionBy(*by).orderBy(dim).rowsBetween(0, gap - 1)
    return df.withColumn("window_sum", F.sum(value).over(w))


def window_values(df: DataFrame, dim: str, gap: int, value: str = "measure", by: Sequence[str] = ()) -> DataFrame:
    """``window_sum``: all rows whose dim is at most gap above the row's."""
    if not by:
        return _ahead(df, dim, gap, value)
    w = Window.partitionBy(*by).orderBy(dim).rangeBetween(0, gap)
    return df.withColumn("window_sum", F.sum(value).over(w))


def _ahead(df: DataFrame, at: str, gap: int, value: str) -> DataFrame:
    """Windows of values over ranges that are as wide as the gap at least: each range also gets the rows of the next one to
    look at, so no task has more than two ranges."""
    low, high, n = df.agg(F.min(at), F.max(at), F.count("*")).first()
    if low is None:
        return df.withColumn("window_sum", F.sum(value).over(Window.partitionBy(at)))  # NULLs are each other's peers
    width = max(gap, 1, -(-(float(high) - float(low)) // max(1, n // RANK_ROWS)))
    own = F.floor((F.col(at) - F.lit(low)) / F.lit(width))
    rows = df.withColumn("_own", own).withColumn("_b", F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own - 1))))
    w = Window.partitionBy("_b").orderBy(at).rangeBetween(0, gap)
    return rows.withColumn("window_sum", F.sum(value).over(w)).where(F.col("_b").eqNullSafe(F.col("_own"))).drop("_own", "_b")


def mean(df: DataFrame, by: Sequence[str], total: str, count: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(total) / F.sum(count)).alias("mean"))


def variance(df: DataFrame, by: Sequence[str], square: str, total: str, count: str) -> DataFrame:
    """From sums of squares, of values and of counts, so that cuboids suffice."""
    m = F.sum(total) / F.sum(count)
    return df.groupBy(*by).agg((F.sum(square) / F.sum(count) - m * m).alias("variance"))


def normalized(df: DataFrame, value: str) -> DataFrame:
    """``z``: distance from the mean in standard deviations, over all rows. One row of statistics comes to the driver."""
    m, sd = df.agg(F.avg(value), F.stddev_pop(value)).first()
    return df.withColumn("z", (F.col(value) - F.lit(m)) / F.lit(sd))


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def exists(df: DataFrame, a: str, b: str, f: Callable[[Column, Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """``found``: whether f holds for some row."""
    return df.groupBy(*by).agg(F.bool_or(f(F.col(a), F.col(b))).alias("found"))


def for_all(df: DataFrame, a: str, b: str, f: Callable[[Column, Column], Column], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_and(f(F.col(a), F.col(b))).alias("found"))


def trend_breaks(df: DataFrame, by: Sequence[str], dim: str, value: str = "measure") -> DataFrame:
    """``breaks``: how often a series turns from rising to falling or back; equal neighbours don't count."""
    w = Window.partitionBy(*by).orderBy(dim)
    steps = df.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(w))).where("_d <> 0")
    turns = steps.withColumn("_t", F.when(F.col("_d") != F.lag("_d").over(w), 1).otherwise(0))
    counted = turns.groupBy(*by).agg(F.sum("_t").cast("long").alias("breaks"))
    return df.select(*by).distinct().join(counted, list(by), "left").fillna(0, ["breaks"]).withColumn("monotone", F.col("breaks") == 0).withColumn("double_peak", F.col("breaks") >= 3)


def query_dimension(df: DataFrame, x: str, y: Column, measure: str = "measure", group: Callable[[Column], Column] | None = None) -> DataFrame:
    """(x, total): for each value of x the sum of the distinct values of y among non-zero cells; sorted by number, then text."""
    pairs = df.groupBy(F.col(x).alias("x"), y.alias("y")).agg(F.sum(measure).alias("_m")).where("_m <> 0")
    label = group(F.col("x")) if group else F.col("x")
    return by_number(pairs.groupBy(label.alias("x")).agg(F.sum("y").alias("total")), "x")


def by_number(df: DataFrame, c: str) -> DataFrame:
    """Numbers in their order, then texts in theirs."""
    text = F.col(c).cast("string")
    return df.orderBy(text.try_cast("double").asc_nulls_last(), text)


def criterion(c: Column, texts: Sequence[str]) -> Column:
    """A field's criteria, any of which may hold: ``v``, ``!v``, ``<v``, ``<=v``, ``>v``, ``>=v``. NULL meets none but !v.
    Against a number, texts compare as numbers, and those that are none meet nothing; against other texts as texts."""
    out = F.lit(False)
    number = c.cast("string").try_cast("double")
    for t in texts:
        for op, f in (("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if t.startswith(op):
                bound = t[len(op) :].strip()
                try:
                    met = f(number, F.lit(float(bound)))
                except ValueError:
                    met = f(c.cast("string"), F.lit(bound))
                out = out | F.coalesce(met, F.lit(False))
                break
        else:
            same = c.cast("string").eqNullSafe(F.lit(t.lstrip("!")))
            out = out | (~same if t.startswith("!") else same)
    return out


def criteria(fields: dict[str, Sequence[str]], any_of: bool = False) -> Column:
    out = None
    for name, texts in fields.items():
        c = criterion(F.col(name), texts)
        out = c if out is None else (out | c if any_of else out & c)
    return F.lit(True) if out is None else out


def value_in_header(header: Column, field: str) -> Column:
    """The value after ``field=`` in a header of ``;``-separated parts; one blank if it isn't there."""
    found = F.regexp_extract(header, rf"(?:^|;)\s*{re.escape(field)}=([^;]*)", 1)
    return F.when(found == "", F.lit(" ")).otherwise(F.trim(found))


def header_labels(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``label``: ``column=v`` for a group with one value, else ``column in (..)``, values sorted."""
    vals = F.array_sort(F.collect_set(F.col(column).cast("string")))
    one = F.concat(F.lit(f"{column}="), F.element_at(vals, 1))
    many = F.concat(F.lit(f"{column} in ("), F.array_join(vals, ", "), F.lit(")"))
    return df.groupBy(*by).agg(F.when(F.size(vals) == 1, one).otherwise(many).alias("label"))


def prefix_labels(df: DataFrame, code: str, value: str, width: int, k: int) -> DataFrame:
    """For each prefix of k bits the first and last value: ``a to b``."""
    group = F.shiftright(F.col(code), width - k).alias("prefix")
    low, high = F.min(F.struct(code, value))[value].cast("string"), F.max(F.struct(code, value))[value].cast("string")
    return df.groupBy(group).agg(F.when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high)).alias("label"))


def number_ranges(code: Column, low_bits: int, start: int = 0) -> tuple[Column, Column]:
    """First and last number of a code's group after its low bits are dropped."""
    first = F.shiftleft(F.shiftright(code, low_bits), low_bits) + start
    return first, first + (1 << low_bits) - 1


def page(df: DataFrame, order: Sequence, number: int, rows: int) -> DataFrame:
    return df.orderBy(*order).offset(number * rows).limit(rows)


def error_metrics(truth: DataFrame, got: DataFrame, key: str = "idx", value: str = "measure") -> DataFrame:
    """One row: l1 (share of the total), max_abs."""
    j = truth.select(key, F.col(value).alias("_t")).join(got.select(key, F.col(value).alias("_g")), key, "full")
    d = F.abs(F.coalesce("_t", F.lit(0)) - F.coalesce("_g", F.lit(0)))
    total = F.sum(F.coalesce("_t", F.lit(0)))
    return j.agg((F.sum(d) / F.when(total != 0, total).otherwise(1)).alias("l1"), F.max(d).alias("max_abs"))


def entropy(df: DataFrame, value: str = "measure", by: Sequence[str] = ()) -> DataFrame:
    """-sum p ln p by way of sums: ln T - sum(v ln v) / T, so one pass is enough."""
    v = F.col(value).cast("double")
    pos = F.when(v > 0, v)
    t = F.sum(pos)
    return df.groupBy(*by).agg((F.ln(t) - F.sum(pos * F.ln(pos)) / t).alias("entropy"), ((F.ln(t) - F.sum(pos * F.ln(pos)) / t) / F.ln(F.lit(2.0))).alias("entropy2"))


def normalized_entropy(df: DataFrame, cells: int, value: str = "measure", by: Sequence[str] = ()) -> DataFrame:
    """Entropy over that of ``cells`` equal cells: 1 if all are equal, absent ones counting as empty."""
    return entropy(df, value, by).select(*by, (F.col("entropy") / F.ln(F.lit(float(cells)))).alias("entropy"))


def floor_to(c: Column, digits: int) -> Column:
    """A number cut down to so many digits after the point."""
    scale = float(10**digits)
    return F.floor(c * scale) / scale


def rename_counts(df: DataFrame, a: Column, b: Column, measure: Column) -> DataFrame:
    """Not-null patterns of two columns: neither, only_b, only_a, both; ``renamed`` if a row has exactly one of them."""
    def s(c):
        return F.coalesce(F.sum(F.when(c, measure)), F.lit(0)).cast("long")

    one = df.agg(s(~a & ~b).alias("neither"), s(~a & b).alias("only_b"), s(a & ~b).alias("only_a"), s(a & b).alias("both"))
    return one.withColumn("renamed", (F.col("neither") == 0) & (F.col("both") == 0))


def null_changes(df: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(column, at, event): every row where a column begins or stops having values, in the order of the rows.

    Without ``by`` rows are numbered first and looked at in parts; a part's first row is held against the last one before."""
    def long(rows: DataFrame, *more: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("has")) for c in columns])).alias("x")
        return rows.select(*by, *more, F.col(order).alias("at"), each).select(*by, *more, "at", "x.column", "x.has")

    if by:
        seen = long(df).withColumn("was", F.lag("has").over(Window.partitionBy(*by, "column").orderBy("at")))
    else:
        rows = long(ranked(df, [order], "_i"), "_i").withColumn("_p", F.floor(F.col("_i") / RANK_ROWS))
        last = rows.groupBy("column", "_p").agg(F.max_by("has", "_i").alias("_last"))
        before = last.select("column", "_p", F.lag("_last").over(Window.partitionBy("column").orderBy("_p")).alias("_before"))  # a row for each part
        seen = rows.withColumn("was", F.lag("has").over(Window.partitionBy("column", "_p").orderBy("_i"))).join(before, ["column", "_p"])
        seen = seen.withColumn("was", F.coalesce("was", "_before"))
    changed = seen.where(F.col("has") != F.coalesce("was", F.lit(False)))
    return changed.select(*by, "column", "at", F.when(F.col("has"), "add").otherwise("remove").alias("event"))


def rename_events(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(at, old, new): rows where exactly one column stops and exactly one begins, which looks like a new name."""
    of = lambda event: F.collect_set(F.when(F.col("event") == event, F.col("column")))  # noqa: E731  as many as there are columns
    found = changes.groupBy(*by, "at").agg(of("remove").alias("gone"), of("add").alias("new"))
    one = found.where((F.size("gone") == 1) & (F.size("new") == 1))
    return one.select(*by, "at", F.element_at("gone", 1).alias("old"), F.element_at("new", 1).alias("new"))
