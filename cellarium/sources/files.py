"""File sources: JSON, CSV, TSV and pipe-separated tables as rows with a measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarium.ranking import ranked


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array of objects, or one object a line; nested fields become dotted columns."""
    return flattened(spark.read.option("multiLine", True).json(path))


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields and array elements as columns ``a.b.0.c``; the array's length is taken from the data."""
    while True:
        nested = [(f.name, f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
        if not nested:
            return df
        arrays = [n for n, t in nested if isinstance(t, T.ArrayType)]
        sizes = df.agg(*[F.max(F.size(F.col(f"`{n}`"))).alias(f"n{i}") for i, n in enumerate(arrays)]).first() if arrays else ()
        length = {n: max(0, sizes[i] or 0) for i, n in enumerate(arrays)}
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                cols += [c.getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
            elif isinstance(f.dataType, T.ArrayType):
                cols += [F.get(c, F.lit(i)).alias(f"{f.name}.{i}") for i in range(length[f.name])]
            else:
                cols.append(c)
        df = df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return _separated(spark, path, ",", True, schema)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return _separated(spark, path, "\t", True, schema)


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-separated without a header; ``path`` may be a pattern of part files."""
    return _separated(spark, path, "|", False, schema)


def _separated(spark: SparkSession, path: str, sep: str, header: bool, schema: str | None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_measure(df: DataFrame, column: str | None = None, map_value: Callable[[Column], Column] | None = None, name: str = "measure") -> DataFrame:
    """Adds the measure: a mapped column as a whole number, 0 where it is missing; without a column 1, so that sums count."""
    if column is None:
        return df.withColumn(name, F.lit(1).cast("long"))
    c = F.col(f"`{column}`")
    return df.withColumn(name, F.coalesce((map_value(c) if map_value else c).try_cast("long"), F.lit(0).cast("long")))


def with_row_number(df: DataFrame, order: list[str], name: str = "Time") -> DataFrame:
    """Adds 0, 1, ... in the order of the columns, NULL first. Ranges come from all of them, so equal times don't meet in one task."""
    return ranked(df, order, name)
