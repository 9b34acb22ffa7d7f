"""Ready schemas of public datasets: which columns a table has, what kind each is, what is measured.

The rows come from files that a user has; the small table stands here. Dates become parts, so that a prefix of one is a
coarser date; texts become dictionaries, numbers magnitudes (``CubeSchema.infer``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.encoders import date_codes
from cellarium.operators.user import UserCube
from cellarium.sources import files

_PARTS = {"d": ("day", "month", "year"), "t": ("minute", "hour"), "y": ("year",), "dt": ("second", "minute", "hour", "day", "month", "year")}


@dataclass(frozen=True)
class Dataset:
    """columns: (name, kind). A kind is ``text``, ``whole``, or (date format, parts, first year). measure: an expression in
    SQL that gives a whole number, None to count rows."""

    name: str
    columns: tuple[tuple[str, object], ...]
    measure: str | None = None

    def rows(self, raw: DataFrame) -> DataFrame:
        """Typed columns and ``_measure``. Numbers and dates that can't be read are missing."""
        out: list[Column] = []
        for name, kind in self.columns:
            c = F.col(f"`{name}`").cast("string")
            if kind == "text":
                out.append(F.when(F.trim(c) != "", c).alias(name))
            elif kind == "whole":
                out.append(F.floor(c.try_cast("double")).cast("long").alias(name))
            else:
                form, parts, first = kind
                at = F.try_to_timestamp(F.trim(c), F.lit(form))
                codes = date_codes(at, first, _PARTS[parts])
                out += [F.when(at.isNotNull(), v).alias(f"{name}.{p}") for p, (v, _) in codes.items()]
        measure = F.lit(1).cast("long") if self.measure is None else F.coalesce(F.expr(self.measure).cast("long"), F.lit(0).cast("long"))
        return raw.select(*out, measure.alias("_measure"))

    def cube(self, raw: DataFrame, path: str | None = None, **options) -> UserCube:
        return UserCube.from_rows(self.rows(raw), "_measure", path, **options)


def _texts(names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, "text") for n in names.split("|"))


# Column names, formats and measures of the public files.
SALES = Dataset("sales by quarter and city", (("City", "text"), ("Quarter", "text")), "try_cast(Sale as bigint)")
WEBSHOP = Dataset(
    "webshop",
    (("year", "whole"), ("quarter", "whole"), ("month", "whole"), ("week", "whole"), ("day", "whole"), *_texts("id|name|category_label|product_label|continent_code|continent_name|country_code|country_name"), ("quantity", "whole")),
    "floor(try_cast(price_total as double) * 100 + 0.5)",
)
PARKING = Dataset(
    "parking tickets",
    (
        *_texts("Plate ID|Registration State|Plate Type"), ("Issue Date", ("MM/dd/yyyy", "d", 1970)),
        *_texts("Violation Code|Vehicle Body Type|Vehicle Make|Issuing Agency|Street Code1|Street Code2|Street Code3"), ("Vehicle Expiration Date", ("yyyyMMdd", "d", 1970)),
        *_texts("Violation Location|Violation Precinct|Issuer Precinct|Issuer Code|Issuer Command|Issuer Squad|Violation Time|Time First Observed|Violation County|Violation In Front Of Or Opposite|House Number|Street Name|Intersecting Street"),
        ("Date First Observed", ("yyyyMMdd", "d", 1970)),
        *_texts("Law Section|Sub Division|Violation Legal Code|Days Parking In Effect|From Hours In Effect|To Hours In Effect|Vehicle Color|Unregistered Vehicle?"),
        ("Vehicle Year", ("yyyy", "y", 1970)), ("Meter Number", "text"), ("Feet From Curb", "whole"),
    ),
)
_CLOCK = ("HHmm", "t", 1970)
FLIGHTS = Dataset(
    "flights",
    (
        *((n, "whole") for n in ("Year", "Quarter", "Month", "DayofMonth", "DayOfWeek")),
        *_texts("Reporting_Airline|DOT_ID_Reporting_Airline|IATA_CODE_Reporting_Airline|Tail_Number"), ("Flight_Number_Reporting_Airline", "whole"),
        *((f"{end}{part}", "text") for end in ("Origin", "Dest") for part in ("AirportID", "AirportSeqID", "CityMarketID", "", "CityName", "State", "StateFips", "StateName", "Wac")),
        ("CRSDepTime", _CLOCK), ("DepTime", _CLOCK), ("DepDelay", "whole"), ("TaxiOut", "whole"), ("WheelsOff", _CLOCK), ("WheelsOn", _CLOCK), ("TaxiIn", "whole"),
        ("CRSArrTime", _CLOCK), ("ArrTime", _CLOCK), ("ArrDelay", "whole"), *_texts("Cancelled|CancellationCode|Diverted"),
        *((n, "whole") for n in ("CRSElapsedTime", "ActualElapsedTime", "AirTime")), ("Flights", "text"), ("Distance", "whole"), ("DistanceGroup", "whole"),
        *((f"{n}Delay", "whole") for n in ("Carrier", "Weather", "NAS", "Security", "LateAircraft")),
    ),
)
MARKETPLACE = Dataset(
    "marketplace orders",
    (
        *_texts("order_id|order_item_id"), ("order_purchase_timestamp", ("yyyy-MM-dd HH:mm:ss", "dt", 2016)),
        *_texts("customer_id|customer_zip_code_prefix|customer_city|customer_state|product_id|product_category_name|seller_id|seller_zip_code_prefix|seller_city|seller_state"),
    ),
    "floor(try_cast(price as double) * 100)",
)
ORDER_LINES = Dataset(
    "order lines",
    (
        ("order_date", ("yyyyMMdd", "d", 1970)), *_texts("ord_priority|ship_priority"), *((n, "whole") for n in ("quantity", "extended_price", "discount", "revenue", "sup_cost", "tax")),
        ("commit_date", ("yyyyMMdd", "d", 1970)), *_texts("ship_mode|cust_city|cust_nation|cust_region|cust_mkt_segment|supp_city|supp_nation|supp_region|mfgr|category|brand|color|type"), ("size", "whole"), ("container", "text"),
    ),
    "floor(try_cast(extended_price as decimal(20,0)) * (100 - try_cast(discount as int)) * (100 + try_cast(tax as int)) / 10000)",
)
#: Pipe-separated files, by position; names that start with _ are keys or unused.
ORDER_LINES_FILES = {
    "lineorder": "_order|_line|_cust|_part|_supp|order_date|ord_priority|ship_priority|quantity|extended_price|_total|discount|revenue|sup_cost|tax|commit_date|ship_mode",
    "customer": "_cust|_cname|_caddress|cust_city|cust_nation|cust_region|_cphone|cust_mkt_segment",
    "supplier": "_supp|_sname|_saddress|supp_city|supp_nation|supp_region|_sphone",
    "part": "_part|_pname|mfgr|category|brand|color|type|size|container",
}


def looked_up(facts: DataFrame, tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Fact rows with the columns of each table by its key. A row whose key a table lacks fails the query, as a lookup would;
    Spark picks each join by the table's size."""
    out = facts
    for table, key in tables:
        out = out.join(table.withColumn("_there", F.lit(True)), key, "left")
        missing = F.raise_error(F.concat(F.lit(f"no row with {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
        out = out.withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(missing)).drop("_there")
    return out


def order_lines(spark: SparkSession, folder: str, parts: str = "lineorder*.tbl") -> DataFrame:
    """The joined rows of ORDER_LINES from its pipe-separated files."""
    def read(name: str, pattern: str) -> DataFrame:
        return files.read_tbl(spark, f"{folder}/{pattern}", ", ".join(f"`{c}` string" for c in ORDER_LINES_FILES[name].split("|")))

    tables = [(read(t, f"{t}.tbl"), key) for t, key in (("customer", "_cust"), ("supplier", "_supp"), ("part", "_part"))]
    return looked_up(read("lineorder", parts), tables)


def marketplace(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """The joined rows of MARKETPLACE."""
    orders = orders.select("order_id", "customer_id", "order_purchase_timestamp")
    customers = customers.select("customer_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    products = products.select("product_id", "product_category_name")
    sellers = sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    return looked_up(items.select("order_id", "order_item_id", "product_id", "seller_id", "price"), [(orders, "order_id"), (customers, "customer_id"), (products, "product_id"), (sellers, "seller_id")])


def sample_of_parts(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows of every partition, for trying things out."""
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_spot", spot).where(F.col("_spot") < rows).drop("_spot")
