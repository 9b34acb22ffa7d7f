"""Cube schemas: which columns a cube has, how each is encoded, and how codes read back.

A schema is declared, or inferred from rows: whole numbers become their magnitude (and a sign column ``-name`` if some
are negative), everything else a sorted dictionary. Columns with missing values get a not-null bit, ``name?``, so that a
missing value and code 0 differ. Dictionaries are tables and stay tables.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarium.functions.bits import width_of
from cellarium.functions.encoders import dictionary, grown

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Level:
    """A dimension of a schema: kind 'nat', 'sign', 'present' or 'dictionary' of the column ``source``."""

    name: str
    width: int
    kind: str
    source: str


@dataclass
class CubeSchema:
    levels: list[Level]
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def columns(self) -> dict[str, int]:
        return {x.name: x.width for x in self.levels}

    @classmethod
    def infer(cls, df: DataFrame, measure: str | None = None) -> CubeSchema:
        """One aggregate over the rows gives all ranges and missing values; dictionaries come from distinct values."""
        fields = [f for f in df.schema.fields if f.name != measure]
        aggs = [F.count("*").alias("n")]
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            aggs.append(F.count(c).alias(f"c{i}"))
            if isinstance(f.dataType, _WHOLE):
                aggs += [F.max(F.abs(c.cast("long"))).alias(f"h{i}"), F.min(c.cast("long")).alias(f"l{i}")]
        r = df.agg(*aggs).first()
        levels, tables = [], {}
        for i, f in enumerate(fields):
            if r[f"c{i}"] < r["n"]:
                levels.append(Level(f"{f.name}?", 1, "present", f.name))
            if isinstance(f.dataType, _WHOLE):
                levels.append(Level(f.name, max(1, width_of((r[f"h{i}"] or 0) + 1)), "nat", f.name))
                if (r[f"l{i}"] or 0) < 0:
                    levels.append(Level(f"-{f.name}", 1, "sign", f.name))
            else:
                t = dictionary(df.select(F.col(f"`{f.name}`").cast("string").alias("value")), "value")
                tables[f.name] = t
                levels.append(Level(f.name, max(1, width_of(t.count())), "dictionary", f.name))
        return cls(levels, tables)

    def extended(self, df: DataFrame) -> CubeSchema:
        """The schema after more rows: new dictionary values get the next codes, widths grow; columns stay."""
        tables = {c: grown(t, df.select(F.col(f"`{c}`").cast("string").alias("value")), "value") if c in df.columns else t for c, t in self.dictionaries.items()}
        whole = {x.source: F.max(F.abs(F.col(f"`{x.source}`").cast("long"))).alias(x.source) for x in self.levels if x.kind == "nat" and x.source in df.columns}
        top = df.agg(*whole.values()).first().asDict() if whole else {}
        levels = []
        for x in self.levels:
            w = x.width
            if x.kind == "dictionary":
                w = max(w, width_of(tables[x.source].count()))
            elif x.kind == "nat" and top.get(x.source):
                w = max(w, width_of(top[x.source] + 1))
            levels.append(Level(x.name, w, x.kind, x.source))
        return CubeSchema(levels, tables)

    def encode(self, df: DataFrame, measure: str = "measure") -> DataFrame:
        """Code columns by dimension name, and the measure. Missing values have code 0 in every dimension."""
        out = df
        for i, (c, t) in enumerate(self.dictionaries.items()):
            look = t.select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_d{i}"))
            out = out.join(look, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        at = {c: i for i, c in enumerate(self.dictionaries)}

        def code(x: Level) -> Column:
            c = F.col(f"`{x.source}`")
            if x.kind == "present":
                v = F.when(c.isNotNull(), 1).otherwise(0)
            elif x.kind == "sign":
                v = F.when(c < 0, 1).otherwise(0)
            elif x.kind == "nat":
                v = F.abs(c.cast("long"))
            else:
                v = F.col(f"_d{at[x.source]}")
            return F.coalesce(v, F.lit(0)).cast("int" if x.width < 32 else "long").alias(x.name)

        return out.select(*[code(x) for x in self.levels], F.col(f"`{measure}`").cast("long").alias("measure"))

    def labelled(self, df: DataFrame, name: str, k: int | None = None, code: str | None = None) -> DataFrame:
        """Adds ``name_label``: the value of a code, or ``first to last`` for a prefix of k bits; NULL for a missing one."""
        x = next(v for v in self.levels if v.name == name)
        c = F.col(f"`{code or name}`")
        k = x.width if k is None else k
        low = x.width - k
        if x.kind != "dictionary":
            first = F.shiftleft(c, low)
            last = first + ((1 << low) - 1)
            text = first.cast("string") if not low else F.concat(first.cast("string"), F.lit(" to "), last.cast("string"))
            if not low and x.kind == "nat" and f"-{name}" in df.columns:  # the sign stands in a column of its own
                text = F.when(F.col(f"`-{name}`") == 1, F.concat(F.lit("-"), text)).otherwise(text)
            return df.withColumn(f"{name}_label", text)
        names = self.dictionaries[x.source].groupBy(F.shiftright("code", low).alias("_g")).agg(F.min(F.struct("code", "value"))["value"].alias("_a"), F.max(F.struct("code", "value"))["value"].alias("_z"))
        joined = df.join(names, c == F.col("_g"), "left")
        return joined.withColumn(f"{name}_label", F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.concat("_a", F.lit(" to "), "_z"))).drop("_g", "_a", "_z")

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps([[x.name, x.width, x.kind, x.source] for x in self.levels])
        spark.createDataFrame([(text, json.dumps(list(self.dictionaries)))], "levels string, dictionaries string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
        for i, t in enumerate(self.dictionaries.values()):
            t.write.mode("overwrite").parquet(f"{path}/dictionary-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CubeSchema:
        r = spark.read.parquet(f"{path}/schema").first()
        names = json.loads(r["dictionaries"])
        return cls([Level(*x) for x in json.loads(r["levels"])], {c: spark.read.parquet(f"{path}/dictionary-{i}") for i, c in enumerate(names)})


@dataclass(frozen=True)
class Tree:
    """A tree of dimensions for natural queries: a leaf has ``bits`` (low to high); the parts of a node are independent
    dimensions if ``cross``, else alternative levels of one hierarchy."""

    name: str
    bits: tuple[int, ...] = ()
    parts: tuple[Tree, ...] = ()
    cross: bool = True

    def queries(self) -> list[tuple[int, ...]]:
        """All natural queries: prefixes of leaves, combined over independent parts."""
        if self.bits:
            return [self.bits[len(self.bits) - k :] if k else () for k in range(len(self.bits) + 1)]
        sub = [p.queries() for p in self.parts]
        if self.cross:
            return sorted({tuple(sorted(itertools.chain.from_iterable(c))) for c in itertools.product(*sub)}, key=lambda s: (len(s), s))
        return sorted(set(itertools.chain.from_iterable(sub)), key=lambda s: (len(s), s))

    def queries_upto(self, q: int) -> list[tuple[int, ...]]:
        return [s for s in self.queries() if len(s) <= q]

    def prefix_counts(self, upto: int) -> list[int]:
        """How many combinations of prefixes have each size."""
        if self.bits:
            return [1 if k <= len(self.bits) else 0 for k in range(upto + 1)]
        if not self.cross:
            counts = [p.prefix_counts(upto) for p in self.parts]
            return [1] + [sum(c[k] for c in counts) for k in range(1, upto + 1)]
        out = [1] + [0] * upto
        for p in self.parts:
            c = p.prefix_counts(upto)
            out = [sum(out[s - k] * c[k] for k in range(s + 1)) for s in range(upto + 1)]
        return out


def presence(df: DataFrame, time: str) -> DataFrame:
    """Rows as null patterns: each column 1 where it has a value; for drift over time."""
    from cellarium.functions.encoders import is_null_code

    return df.select(time, *[is_null_code(F.col(f"`{c}`")).alias(c) for c in df.columns if c != time])


def types_of(df: DataFrame, time: str) -> DataFrame:
    """Rows as the names of the types that their values look like."""
    from cellarium.functions.encoders import type_name

    return df.select(time, *[type_name(F.col(f"`{c}`")).alias(c) for c in df.columns if c != time])


def required(rows: Sequence[dict]) -> list[str]:
    """Fields that every record has."""
    return sorted(set.intersection(*(set(r) for r in rows))) if rows else []
