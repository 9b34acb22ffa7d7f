"""The user's cube: from records to answers in the forms users ask for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.analytics import criteria, query_dimension, trend_breaks
from cellarium.operators.cube import Cube
from cellarium.operators.cuboid import base_cuboid
from cellarium.operators.schema import CubeSchema
from cellarium.plans import strategies
from cellarium.sources import files

#: Most rows that an answer in arrays brings to the driver.
ARRAY_ROWS = 100_000
FORMS = ("tuples", "bits", "matrix", "array")


class UserCube:
    """A schema and its cube."""

    def __init__(self, schema: CubeSchema, cube: Cube):
        self.schema, self.cube = schema, cube

    @classmethod
    def from_rows(cls, df: DataFrame, measure: str | None = None, path: str | None = None, log_n: int = 8, min_d: int = 4, max_d: int = 8, seed: int = 0) -> UserCube:
        """Infers the schema; with a path also materializes random cuboids there."""
        rows = files.with_measure(df, measure, name="_measure")
        schema = CubeSchema.infer(rows.drop(*([measure] if measure else []), "_measure"))
        codes = schema.encode(rows, "_measure")
        cube = Cube(schema.columns, base_cuboid(codes, list(schema.columns)))
        if path:
            cube = cube.materialize(strategies.randomized(cube.n_bits, log_n, min_d, min(max_d, cube.n_bits - 1), seed), path)
            schema.save(df.sparkSession, path)
        return cls(schema, cube)

    @classmethod
    def from_json(cls, spark: SparkSession, source: str, measure: str | None = None, path: str | None = None, **options) -> UserCube:
        return cls.from_rows(files.read_json(spark, source), measure, path, **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> UserCube:
        return cls(CubeSchema.load(spark, path), Cube.load(spark, path))

    def bits_of(self, spec: dict[str, int]) -> list[int]:
        """The k most significant bits of each named column."""
        return [b for c, k in spec.items() for b in self.cube.prefix_bits(c, k)]

    def query(self, rows: dict[str, int], cols: dict[str, int] | None = None, where: dict[str, Sequence[str]] | None = None, any_of: bool = False, method: str = "naive", form: str = "tuples", zero: bool = False, primary: tuple | None = None):
        """Sums by the prefixes in ``rows`` and ``cols`` of what meets the criteria ``where``: on these columns' labels, or
        on any other column's values, whose rows are then filtered before they are summed (``naive`` only).

        form: ``tuples`` (a label column for each dimension), ``bits`` (a 0/1 column for each bit), ``matrix`` (a pivot
        over the labels of ``cols``) or ``array`` (row labels, column labels, values). method: ``naive`` or ``moment``.
        """
        if form not in FORMS:
            raise ValueError(f"form is one of {FORMS}")
        spec = rows | (cols or {})
        others = {c: v for c, v in (where or {}).items() if c not in spec}
        if others and method != "naive":
            raise ValueError("criteria on columns that are not axes need the exact method")
        df = self._filtered(spec, where, any_of) if others else self._codes(spec, method, primary)
        if not zero:
            df = df.where("measure <> 0")
        if form == "bits":
            bits = [F.shiftright(F.col(f"`{c}`"), i).bitwiseAND(F.lit(1)).alias(f"b{b}") for c, k in spec.items() for i, b in enumerate(self.cube.prefix_bits(c, k))]
            return df.select(*bits, "measure")
        for c, k in spec.items():
            df = self.schema.labelled(df, c, k)
        df = df.select(*[F.col(f"`{c}_label`").alias(c) for c in spec], "measure")
        if where and not others:
            df = df.where(criteria({f"`{c}`": v for c, v in where.items()}, any_of))
        if form == "tuples" or not cols:
            return df
        pivot = df.select(*[F.col(f"`{c}`") for c in rows], F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`"), F.lit("NULL"))) for c in cols]).alias("_p"), "measure").groupBy(*[f"`{c}`" for c in rows]).pivot("_p").agg(F.sum("measure")).orderBy(*[f"`{c}`" for c in rows])
        return pivot if form == "matrix" else _arrays(pivot, list(rows))

    def _filtered(self, spec: dict[str, int], where: dict[str, Sequence[str]], any_of: bool) -> DataFrame:
        """Sums by prefixes over the rows that meet the criteria; a prefix's label counts for an axis."""
        rows, fields = self.cube.base, {}
        for c, texts in where.items():
            k = spec.get(c, self.cube.columns[c])
            rows = rows.withColumn(f"_{c}", F.shiftright(F.col(f"`{c}`"), self.cube.columns[c] - k))
            rows = self.schema.labelled(rows, c, k, code=f"_{c}").drop(f"_{c}")
            fields[f"`{c}_label`"] = texts
        rows = rows.where(criteria(fields, any_of)).select(*[f"`{c}`" for c in self.cube.columns], "measure")
        return Cube(self.cube.columns, rows).query(spec)

    def _codes(self, spec: dict[str, int], method: str, primary) -> DataFrame:
        if method == "naive":
            return self.cube.query(spec)
        query = sorted(self.bits_of(spec))
        x = self.cube.solve(query, primary=primary)
        cells = self.cube.base.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, measure double")

        def code(c: str, k: int) -> Column:
            out = F.lit(0).cast("int")
            for i, b in enumerate(self.cube.prefix_bits(c, k)):
                out = out + F.shiftleft(F.shiftright("idx", query.index(b)).bitwiseAND(F.lit(1)).cast("int"), i)
            return out.alias(c)

        return cells.select(*[code(c, k) for c, k in spec.items()], "measure")

    def query_all(self) -> DataFrame:
        """Every dimension in full; cells of 0 left out."""
        return self.query({c: w for c, w in self.cube.columns.items()})

    def query_dimension(self, x: str, y: str, group: Callable[[Column], Column] | None = None) -> DataFrame:
        """For each value of x the sum of the distinct values of the whole-number column y."""
        df = self.schema.labelled(self.cube.query({x: self.cube.columns[x], y: self.cube.columns[y]}), x)
        return query_dimension(df, f"{x}_label", F.col(f"`{y}`"), group=group)


    def trends(self, series: str, dim: str, where: dict[str, Sequence[str]] | None = None) -> DataFrame:
        """For each value of ``series``: how often the sums along ``dim`` turn, whether they rise or fall all the way, whether
        they peak twice."""
        spec = {series: self.cube.columns[series], dim: self.cube.columns[dim]}
        rows = self._filtered(spec, where, False) if where else self.cube.query(spec)
        rows = self.schema.labelled(rows, series)
        return trend_breaks(rows.select(F.col(f"`{series}_label`").alias("series"), F.col(f"`{dim}`").alias("at"), "measure"), ["series"], "at")


def _arrays(pivot: DataFrame, rows: list[str]) -> tuple[list[tuple], list[str], np.ndarray]:
    """Row labels, column labels and values of a pivot that a user looks at: ARRAY_ROWS rows at most."""
    found = pivot.limit(ARRAY_ROWS + 1).collect()
    if len(found) > ARRAY_ROWS:
        raise ValueError(f"an array has {ARRAY_ROWS} rows at most; ask for a matrix")
    top = [c for c in pivot.columns if c not in rows]
    return [tuple(r[c] for c in rows) for r in found], top, np.array([[r[c] or 0 for c in top] for r in found])


def printed(df: DataFrame, rows: int = 20) -> str:
    """A plain table of the first rows."""
    found = [[("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect()]
    wide = [max([len(c), *(len(r[i]) for r in found)]) for i, c in enumerate(df.columns)]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)) for r in [df.columns, *found])
