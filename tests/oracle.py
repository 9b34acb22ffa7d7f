"""Spark rows and DuckDB rows of the same query, made comparable."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(found, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(df.dtypes)
    for c, t in zip(want.columns, want.types, strict=True):
        assert TYPES.get(str(t), kinds[c]) == kinds[c], (c, t, kinds[c])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)
