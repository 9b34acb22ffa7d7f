"""The star schema of the data folder as typed code columns.

One int code column for each dimension, so scans read only the columns a query names. The join strategy of each lookup
is left to Spark, which knows the sizes: small dimension tables are broadcast, large ones shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Money in whole cents, so that sums are exact.
CENTS = "cast(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) as bigint)"


@dataclass(frozen=True)
class Dim:
    """A dimension: the expression of its code, the code's width in bits, the lookups it needs, and what a range of codes
    {a}..{b} is on the source column, so that a slice reaches the Parquet reader."""

    name: str
    width: int
    sql: str
    tables: tuple[str, ...] = ()
    bounds: str | None = None


#: Codes are written as SQL over the joined tables; text domains are coded by their place in the list.
DIMS = (
    Dim("returnflag", 2, "array_position(array('A','N','R'), l_returnflag) - 1"),
    Dim("linestatus", 1, "array_position(array('F','O'), l_linestatus) - 1"),
    Dim("linenumber", 3, "l_linenumber - 1", (), "l_linenumber between {a} + 1 and {b} + 1"),
    Dim("quantity", 6, "cast(l_quantity as int) - 1", (), "l_quantity >= {a} + 1.0 and l_quantity < {b} + 2.0"),
    Dim("discount", 4, "cast(floor(l_discount * 100 + 0.5) as int)", (), "l_discount > ({a} - 1) / 100.0 and l_discount < ({b} + 1) / 100.0"),
    Dim("tax", 4, "cast(floor(l_tax * 100 + 0.5) as int)", (), "l_tax > ({a} - 1) / 100.0 and l_tax < ({b} + 1) / 100.0"),
    Dim("shipyear", 3, "year(l_shipdate) - 1995", (), "l_shipdate >= make_date(1995 + {a}, 1, 1) and l_shipdate < make_date(1996 + {b}, 1, 1)"),
    Dim("shipmonth", 4, "month(l_shipdate) - 1"),
    Dim("shipday", 5, "dayofmonth(l_shipdate) - 1"),
    Dim("orderstatus", 2, "array_position(array('F','O','P'), o_orderstatus) - 1", ("orders",)),
    Dim("orderyear", 3, "year(o_orderdate) - 1995", ("orders",), "o_orderdate >= make_date(1995 + {a}, 1, 1) and o_orderdate < make_date(1996 + {b}, 1, 1)"),
    Dim("orderquarter", 2, "quarter(o_orderdate) - 1", ("orders",)),
    Dim("ordermonth", 4, "month(o_orderdate) - 1", ("orders",)),
    Dim("orderday", 5, "dayofmonth(o_orderdate) - 1", ("orders",)),
    Dim("custnation", 5, "c_nationkey", ("orders", "customer"), "c_nationkey between {a} and {b}"),
    Dim("custregion", 3, "cn.n_regionkey", ("orders", "customer", "cn")),
    Dim("suppnation", 5, "s_nationkey", ("supplier",), "s_nationkey between {a} and {b}"),
    Dim("suppregion", 3, "sn.n_regionkey", ("supplier", "sn")),
    Dim("partsize", 6, "p_size - 1", ("part",), "p_size between {a} + 1 and {b} + 1"),
)
BY_NAME = {d.name: d for d in DIMS}

_JOINS = {
    "orders": "join orders on l_orderkey = o_orderkey",
    "customer": "join customer on o_custkey = c_custkey",
    "cn": "join nation cn on c_nationkey = cn.n_nationkey",
    "supplier": "join supplier on l_suppkey = s_suppkey",
    "sn": "join nation sn on s_nationkey = sn.n_nationkey",
    "part": "join part on l_partkey = p_partkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_sql(names: list[str], where: str = "") -> str:
    """SQL of the fact rows with the named code columns and ``measure``; only the lookups that they need are joined."""
    needed = [t for t in _JOINS if any(t in BY_NAME[n].tables for n in names)]
    cols = ", ".join(f"cast({BY_NAME[n].sql} as int) as {n}" for n in names)
    joins = " ".join(_JOINS[t] for t in needed)
    return f"select {cols}{', ' if cols else ''}{CENTS} as measure from lineitem {joins} {where}"


def star(spark: SparkSession, sf_dir: str, names: list[str] | None = None, ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The fact rows: a code column for each named dimension (all if None) and ``measure`` in cents.

    ranges: dimension -> (first, last code) that rows must have. Bounds on the source columns go to the Parquet readers;
    the codes themselves are tested too, so the bounds may be wide."""
    names = [d.name for d in DIMS] if names is None else list(names)
    ranges = ranges or {}
    wanted, names = names, [*names, *(n for n in ranges if n not in names)]
    needed = {"lineitem", *(t for n in names for t in BY_NAME[n].tables)}
    views = {"lineitem": "lineitem", "orders": "orders", "customer": "customer", "supplier": "supplier", "part": "part", "cn": "nation", "sn": "nation"}
    tests = [BY_NAME[n].bounds.format(a=a, b=b) for n, (a, b) in ranges.items() if BY_NAME[n].bounds]
    text = star_sql(names, f"where {' and '.join(tests)}" if tests else "")
    args = {}
    for t in {views[n] for n in needed}:
        args[t] = table(spark, sf_dir, t)
    # DataFrames are named in the text as {lineitem} and so on; no view is left behind
    for t in sorted(args, key=len, reverse=True):
        text = text.replace(f"join {t} ", f"join {{{t}}} ").replace(f"from {t} ", f"from {{{t}}} ")
    out = spark.sql(text, **args)
    for n, (a, b) in ranges.items():
        out = out.where(F.col(n).between(a, b))
    return out.select(*wanted, "measure") if wanted != names else out


def bit_column(name: str, b: int) -> Column:
    """Bit b of a dimension's code."""
    return F.shiftright(F.col(name), b).bitwiseAND(F.lit(1))


def global_bits() -> list[tuple[str, int]]:
    """Every binary dimension: (dimension, bit), numbered from 0."""
    return [(d.name, b) for d in DIMS for b in range(d.width)]
