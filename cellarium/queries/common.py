"""Registration of queries, and the star schema's code columns as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that it is held against."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def _case(column: str, values: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


DUCK = {
    "returnflag": _case("l_returnflag", "ANR"), "linestatus": _case("l_linestatus", "FO"), "linenumber": "l_linenumber - 1",
    "quantity": "CAST(l_quantity AS INT) - 1", "discount": "CAST(FLOOR(l_discount * 100 + 0.5) AS INT)", "tax": "CAST(FLOOR(l_tax * 100 + 0.5) AS INT)",
    "shipyear": "year(l_shipdate) - 1995", "shipmonth": "month(l_shipdate) - 1", "shipday": "day(l_shipdate) - 1",
    "orderstatus": _case("o_orderstatus", "FOP"), "orderyear": "year(o_orderdate) - 1995", "orderquarter": "quarter(o_orderdate) - 1",
    "ordermonth": "month(o_orderdate) - 1", "orderday": "day(o_orderdate) - 1", "custnation": "c_nationkey", "custregion": "cn.n_regionkey",
    "suppnation": "s_nationkey", "suppregion": "sn.n_regionkey", "partsize": "p_size - 1",
}
CENTS = "CAST(FLOOR(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT)"
STAR = (
    "WITH star AS (SELECT "
    + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in DUCK.items())
    + f", {CENTS} AS measure FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey"
    + " JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey)"
)
SUM = "CAST(SUM(measure) AS BIGINT) AS measure"
