"""Encoders: how a user's column becomes an int code column of a fixed number of bits.

Widths come from the domain: ceil(log2(domain size)). Nullable numeric encoders keep code 0 for NULL and for values
that can't be read. Dictionaries are tables (value, code), joined; Spark picks the join by their size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.ranking import ranked

from .bits import prefix, width_of

#: Texts that count as no value.
NO_VALUE = ("", "null", "n/a")


def is_null_code(c: Column) -> Column:
    """0 for NULL and for texts that stand for it, else 1."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull() | text.isin(*NO_VALUE), F.lit(0)).otherwise(F.lit(1))


_DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "yyyyMMdd")
_PHONE = r"^(\+?1[ .-]?)?(\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}$"


def type_name(c: Column) -> Column:
    """The name of the type a text looks like; the first that fits: Int, Long, Double, URL, File Path:Line Number,
    File Path, US phone number, Date, String; Any for NULL."""
    text = F.trim(c.cast("string"))
    whole = text.rlike(r"^[+-]?\d{1,18}$")
    number = text.try_cast("double")
    is_date = F.lit(False)
    for f in _DATE_FORMATS:
        is_date = is_date | F.try_to_timestamp(text, F.lit(f)).isNotNull()
    return (
        F.when(c.isNull(), F.lit("Any"))
        .when(whole & text.try_cast("int").isNotNull(), F.lit("Int"))
        .when(whole, F.lit("Long"))
        .when(number.isNotNull() & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit("Double"))
        .when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://\S+$"), F.lit("URL"))
        .when(text.rlike(r"^(/|\./|\.\./|[A-Za-z]:\\)?[\w.-]+([/\\][\w.-]+)+:\d+$"), F.lit("File Path:Line Number"))
        .when(text.rlike(r"^(/|\./|\.\./|[A-Za-z]:\\)[\w.-]+([/\\][\w.-]+)*/?$"), F.lit("File Path"))
        .when(text.rlike(_PHONE), F.lit("US phone number"))
        .when(is_date, F.lit("Date"))
        .otherwise(F.lit("String"))
    )


@dataclass(frozen=True)
class Encoder:
    """A column, its bits, and how a value becomes a code."""

    name: str
    width: int

    def code(self) -> Column:
        raise NotImplementedError

    def label(self, code: Column) -> Column:
        """The value that a code stands for."""
        raise NotImplementedError

    def encoded(self, df: DataFrame) -> DataFrame:
        return df.withColumn(f"{self.name}_code", self.code())

    def prefix(self, k: int) -> Column:
        return prefix(F.col(f"{self.name}_code"), self.width, k)


@dataclass(frozen=True)
class Nat(Encoder):
    """Whole numbers low..high; ``nullable`` keeps 0 for NULL and for what is no number in the range."""

    low: int = 0
    high: int = 1
    nullable: bool = False
    map: Callable[[Column], Column] | None = field(default=None, compare=False)

    @classmethod
    def of(cls, name: str, low: int, high: int, nullable: bool = False, map=None) -> Nat:
        return cls(name, width_of(high - low + 1 + nullable), low, high, nullable, map)

    def code_of(self, c: Column) -> Column:
        v = (self.map(c) if self.map else c).try_cast("int")
        shifted = v - self.low + int(self.nullable)
        fits = v.between(self.low, self.high)
        return F.when(fits, shifted).otherwise(F.lit(0)).cast("int") if self.nullable else F.coalesce(F.when(fits, shifted), F.lit(0)).cast("int")

    def code(self) -> Column:
        return self.code_of(F.col(self.name))

    def value_code(self, v: int) -> int:
        return v - self.low + int(self.nullable)

    def label(self, code: Column) -> Column:
        v = code + self.low - int(self.nullable)
        return F.when((code == 0) if self.nullable else F.lit(False), F.lit(None).cast("int")).otherwise(F.when(v <= self.high, v))


def fixed_point(decimals: int) -> Callable[[Column], Column]:
    """The map of a number to whole units of 10**-decimals, for ``Nat``."""
    return lambda c: F.floor(c * (10**decimals) + 0.5)


@dataclass(frozen=True)
class Dictionary(Encoder):
    """A closed domain, sorted: the code is the rank. The values stand in a table of (value, code)."""

    table: DataFrame | None = field(default=None, compare=False)

    @classmethod
    def build(cls, df: DataFrame, name: str) -> Dictionary:
        table = dictionary(df, name)
        n = table.count()
        return cls(name, width_of(n), table)

    def encoded(self, df: DataFrame) -> DataFrame:
        t = self.table.select(F.col("value").alias("_v"), F.col("code").alias(f"{self.name}_code"))
        return df.join(t, df[self.name] == t["_v"], "left").drop("_v")

    def decoded(self, df: DataFrame, code: str | None = None) -> DataFrame:
        t = self.table.select(F.col("value").alias(self.name), F.col("code").alias("_c"))
        return df.join(t, df[code or f"{self.name}_code"] == t["_c"], "left").drop("_c")


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """(value, code): distinct values of a column in order, coded from 0. Ranges are sampled, so no task sorts a domain,
    whatever its values begin with."""
    values = df.select(F.col(name).alias("value")).where(F.col(name).isNotNull()).distinct()
    return ranked(values, ["value"], "code").withColumn("code", F.col("code").cast("int"))


def grown(table: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """An open domain: values that the dictionary lacks get the next codes, in order; codes once given stay."""
    new = df.select(F.col(name).alias("value")).where(F.col(name).isNotNull()).distinct().join(table, "value", "left_anti")
    n = table.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("m")).first()["m"]
    fresh = dictionary(new, "value").select("value", (F.col("code") + int(n) + 1).cast("int").alias("code"))
    return table.unionByName(fresh)


#: Parts of a timestamp, least significant first.
DATE_PARTS = ("second", "minute", "hour", "day", "month", "quarter", "year")


def date_codes(c: Column, first_year: int, parts: Sequence[str] = ("day", "month", "quarter", "year")) -> dict[str, tuple[Column, int]]:
    """Code and width of each part of a timestamp; NULL becomes code 0 of every part."""
    ranges = {"second": (F.second(c), 0, 59), "minute": (F.minute(c), 0, 59), "hour": (F.hour(c), 0, 23), "day": (F.dayofmonth(c), 1, 31), "month": (F.month(c), 1, 12), "quarter": (F.quarter(c), 1, 4), "year": (F.year(c), first_year, first_year + 63)}
    out = {}
    for p in parts:
        v, low, high = ranges[p]
        out[p] = F.coalesce(v - low, F.lit(0)).cast("int"), width_of(high - low + 1)
    return out


def position_codes(c: Column, lon0: float, lat0: float, decimals: int = 4) -> tuple[Column, Column]:
    """Fixed-point offsets of ``POINT (lon lat)`` texts from a reference point; NULL where the text is no point."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    lon, lat = (F.regexp_extract(c, pattern, i).try_cast("double") for i in (1, 2))
    scale = 10**decimals
    return F.floor((lon - lon0) * scale + 0.5).cast("int"), F.floor((lat - lat0) * scale + 0.5).cast("int")


def nested(c: Column, split: Callable[[Column], tuple[Column, Column]]) -> tuple[Column, Column]:
    """A hierarchical text as (prefix, suffix) columns, each coded by a dictionary of its own."""
    return split(c)


def signed(c: Column) -> tuple[Column, Column]:
    """A whole number as (absolute value, sign bit)."""
    return F.abs(c), F.when(c < 0, 1).otherwise(0)
