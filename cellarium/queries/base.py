"""Sources, encoders, predicates, joins and aggregates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellarium.functions import bits as B
from cellarium.functions import encoders as E
from cellarium.operators import analytics as A
from cellarium.operators import cuboid as C
from cellarium.queries.common import CENTS, STAR, SUM, query
from cellarium.sources import datasets, files, generators
from cellarium.sources.star import star, table


# flagship ---------------------------------------------------------------------------------------------------------
@query(f"""SELECT CAST(y AS INT) AS order_year, r AS region, CAST(SUM(m) AS BIGINT) AS revenue_cents, COUNT(*) AS n_rows FROM (
  SELECT year(o_orderdate) y, r_name r, {CENTS} m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2""")
def naive_year_region(spark, d):
    """Revenue by order year and customer region."""
    rows = star(spark, d, ["orderyear", "custregion"]).groupBy("orderyear", "custregion").agg(F.sum("measure").alias("revenue_cents"), F.count("*").alias("n_rows"))
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("custregion"), F.col("r_name").alias("region"))
    return rows.join(names, "custregion").select((F.col("orderyear") + 1995).cast("int").alias("order_year"), "region", "revenue_cents", "n_rows")


# sources ------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def source_json_flatten(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return files.flattened(e).withColumnRenamed("props.k", "k")


@query("SELECT event_id, COALESCE(TRY_CAST(FLOOR(value * 100 + 0.5) AS BIGINT), 0) AS measure FROM events")
def source_measure(spark, d):
    return files.with_measure(table(spark, d, "events"), "value", lambda c: F.floor(c * 100 + 0.5)).select("event_id", "measure")


@query("SELECT event_type, COUNT(*) AS measure FROM events GROUP BY 1")
def source_count_measure(spark, d):
    return files.with_measure(table(spark, d, "events")).groupBy("event_type").agg(F.sum("measure").alias("measure"))


@query('SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS "Time" FROM events')
def source_row_number(spark, d):
    return files.with_row_number(table(spark, d, "events"), ["ts", "event_id"]).select("event_id", "Time")


@query("""SELECT t AS "Time", CAST(5 AS BIGINT) AS c, CAST(FLOOR(t * 2.5 + 1) AS BIGINT) AS lin, CAST(FLOOR(SIN(t * (2 * 3.141592653589793 / 50) + 0.0) * 100 + 0.5) AS BIGINT) AS sn,
  CAST(FLOOR(t * 2.5 + 1) AS BIGINT) * 3 AS mp, CAST(5 + FLOOR(t * 2.5 + 1) AS BIGINT) AS sm FROM (SELECT range AS t FROM range(1000))""")
def generator_values(spark, d):
    lin = generators.linear(2.5, 1)
    return generators.tuples(spark, 1000, {"c": generators.constant(5), "lin": lin, "sn": generators.sine(100, 50), "mp": generators.mapped(lin, lambda c: c * 3), "sm": generators.summed(generators.constant(5), lin)})


@query("SELECT replaced, CAST(4096 AS BIGINT) AS total, TRUE AS in_range, NOT replaced AS all_differ FROM (VALUES (TRUE), (FALSE)) t(replaced)")
def generator_random_cube(spark, d):
    """What holds for every seed: the number of rows, the range of keys, and whether all differ."""
    out = None
    for again in (True, False):
        rows = generators.random_cube(spark, 16, 12, seed=1, replace=again)
        one = rows.agg(F.sum("measure").alias("total"), F.bool_and(F.col("key").between(0, (1 << 16) - 1)).alias("in_range"), (F.count_distinct("key") == F.count("*")).alias("all_differ")).select(F.lit(again).alias("replaced"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT CAST(range AS BIGINT) AS idx, CAST(FLOOR(1000000.0 * POWER(0.3, bit_count(range)) * POWER(0.7, 10 - bit_count(range))) AS BIGINT) AS measure FROM range(1024)")
def generator_micro_bench(spark, d):
    """Without noise every cell is its product."""
    return generators.micro_bench(spark, 10, stddev=0.0, seed=2)


@query("SELECT * FROM (VALUES ('u', 5000::BIGINT, TRUE, FALSE), ('h', 5000, TRUE, TRUE), ('t', 5000, TRUE, FALSE), ('walk', 5000, TRUE, FALSE), ('random', 5000, TRUE, FALSE)) x(name, n, in_range, mostly_small)")
def generator_sampled_columns(spark, d):
    """Sampled columns keep to their ranges; the half Gaussian one is mostly small."""
    top = {"u": 15, "h": 15, "t": 31, "walk": 15, "random": 15}
    rows = generators.tuples(spark, 5000, {"u": lambda t: generators.uniform(16, 1), "h": lambda t: generators.half_gaussian(16, 2), "t": lambda t: generators.trend(t, 32, 5000, 3), "random": generators.random_value(0, 15, 4)})
    rows = rows.join(generators.random_walk(spark, 16, 5000, 5).withColumnRenamed("code", "walk"), "Time")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v"), F.lit(k).alias("top")) for c, k in top.items()])).alias("x")).select("x.*")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.bool_and(F.col("v").between(0, F.col("top"))).alias("in_range"), (F.avg(F.when(F.col("v") < (F.col("top") + 1) / 2, 1.0).otherwise(0.0)) > 0.85).alias("mostly_small"))


@query("""SELECT CAST(c_nationkey AS INT) AS custnation, CAST(s_nationkey AS INT) AS suppnation, CAST(SUM(CAST(FLOOR(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT)) AS BIGINT) AS measure
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def join_dimension_lookup(spark, d):
    return star(spark, d, ["custnation", "suppnation"]).groupBy("custnation", "suppnation").agg(F.sum("measure").alias("measure"))


@query("SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_checked_lookup(spark, d):
    """Lookups that fail on a missing key instead of dropping rows."""
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = datasets.looked_up(facts, [(orders, "o_orderkey"), (table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")])
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SELECT event_id, COALESCE(CASE WHEN event_id % 2 = 0 THEN user_id END, CASE WHEN event_id % 2 = 1 THEN user_id + 1000 END) AS merged FROM events")
def join_merge_renamed(spark, d):
    from cellarium.sessions import ExploreSession

    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("a"), F.when(F.col("event_id") % 2 == 1, F.col("user_id") + 1000).alias("b"))
    return ExploreSession(e, "event_id").merged("a", "b", "merged")


# encoders -----------------------------------------------------------------------------------------------------------
@query("SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def encode_dictionary(spark, d):
    return E.dictionary(table(spark, d, "part"), "p_brand")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS p_type_code, p_type AS decoded FROM part")
def decode_dictionary(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    enc = E.Dictionary.build(part, "p_type")
    return enc.decoded(enc.encoded(part).drop("p_type")).select("p_partkey", "p_type_code", F.col("p_type").alias("decoded"))


@query("""SELECT value, CAST(CASE WHEN old THEN row_number() OVER (PARTITION BY old ORDER BY value) - 1 ELSE (SELECT COUNT(DISTINCT p_brand) FROM part WHERE p_size <= 2) + row_number() OVER (PARTITION BY old ORDER BY value) - 1 END AS INT) AS code
 FROM (SELECT p_brand AS value, bool_or(p_size <= 2) AS old FROM part GROUP BY 1)""")
def encode_open_domain(spark, d):
    part = table(spark, d, "part")
    return E.grown(E.dictionary(part.where("p_size <= 2"), "p_brand"), part, "p_brand")


@query("SELECT event_id, CAST(CASE WHEN CAST(FLOOR(value) AS INT) BETWEEN 10 AND 200 THEN CAST(FLOOR(value) AS INT) - 10 + 1 ELSE 0 END AS INT) AS code FROM events")
def encode_nullable_range(spark, d):
    enc = E.Nat.of("value", 10, 200, nullable=True, map=F.floor)
    return table(spark, d, "events").select("event_id", enc.code().alias("code"))


@query("SELECT l_orderkey, l_linenumber, CAST(FLOOR(l_discount * 100 + 0.5) AS INT) AS discount_code, CAST(FLOOR(l_tax * 100 + 0.5) AS INT) AS tax_code FROM lineitem")
def encode_fixed_point(spark, d):
    cols = [E.Nat.of(c, 0, 15, map=E.fixed_point(2)).code().alias(f"{c[2:]}_code") for c in ("l_discount", "l_tax")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)


@query("SELECT event_id, CAST(minute(ts) AS INT) AS minute, CAST(hour(ts) AS INT) AS hour, CAST(day(ts) - 1 AS INT) AS day, CAST(month(ts) - 1 AS INT) AS month, CAST(quarter(ts) - 1 AS INT) AS quarter, CAST(year(ts) - 2020 AS INT) AS year FROM events")
def encode_date_parts(spark, d):
    codes = E.date_codes(F.col("ts"), 2020, ("minute", "hour", "day", "month", "quarter", "year"))
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, (c, _) in codes.items()])


@query("SELECT event_id, CAST(FLOOR((user_id * 0.5 - 10) * 100 + 0.5) AS INT) AS lon, CAST(FLOOR((user_id * 0.25 - 5) * 100 + 0.5) AS INT) AS lat FROM events")
def encode_position(spark, d):
    point = F.concat(F.lit("POINT ("), (F.col("user_id") * 0.5).cast("string"), F.lit(" "), (F.col("user_id") * 0.25).cast("string"), F.lit(")"))
    lon, lat = E.position_codes(point, 10, 5, 2)
    return table(spark, d, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))


@query("SELECT event_id, CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS not_null FROM events")
def encode_is_null(spark, d):
    text = F.when(F.col("user_id") % 3 != 0, F.col("event_type")).when(F.col("user_id") % 2 == 0, F.lit("N/A"))
    return table(spark, d, "events").select("event_id", E.is_null_code(text).alias("not_null"))


@query("""SELECT 'event_id' AS c, 'Int' AS t, COUNT(*) AS n FROM events UNION ALL SELECT 'event_type', 'String', COUNT(*) FROM events
 UNION ALL SELECT 'url', 'URL', COUNT(*) FROM pages UNION ALL SELECT 'ts', 'Date', COUNT(*) FROM events""")
def encode_type_names(spark, d):
    e, p = table(spark, d, "events"), table(spark, d, "pages")
    parts = [e.select(F.lit(n).alias("c"), E.type_name(c).alias("t")) for n, c in (("event_id", F.col("event_id")), ("event_type", F.col("event_type")), ("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))]
    parts.append(p.select(F.lit("url").alias("c"), E.type_name(F.col("url")).alias("t")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.groupBy("c", "t").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(abs(FLOOR(c_acctbal)) AS BIGINT) AS magnitude, CAST(CASE WHEN FLOOR(c_acctbal) < 0 THEN 1 ELSE 0 END AS INT) AS sign FROM customer")
def encode_signed(spark, d):
    a, s = E.signed(F.floor("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", a.alias("magnitude"), s.alias("sign"))


@query("SELECT CAST((CAST(l_quantity AS INT) - 1) >> 3 AS INT) AS prefix, MIN(CAST(l_quantity AS INT))::VARCHAR || ' to ' || MAX(CAST(l_quantity AS INT))::VARCHAR AS label FROM lineitem GROUP BY 1")
def prefix_labels_quantity(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity").cast("int") - 1).alias("code"), F.col("l_quantity").cast("int").alias("quantity"))
    return A.prefix_labels(rows, "code", "quantity", 6, 3)


@query("SELECT DISTINCT q AS code, CAST((q >> 2) << 2 AS INT) + 1 AS first, CAST((q >> 2) << 2 AS INT) + 4 AS last FROM (SELECT CAST(l_quantity AS INT) - 1 AS q FROM lineitem)")
def number_ranges(spark, d):
    first, last = A.number_ranges(F.col("quantity"), 2, 1)
    return star(spark, d, ["quantity"]).select("quantity").distinct().select(F.col("quantity").alias("code"), first.alias("first"), last.alias("last"))


@query("""SELECT r_name AS g, CASE WHEN COUNT(DISTINCT n_name) = 1 THEN 'n_name=' || MIN(n_name) ELSE 'n_name in (' || string_agg(DISTINCT n_name, ', ' ORDER BY n_name) || ')' END AS label
 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def header_labels(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "g")
    return A.header_labels(rows, ["g"], "n_name")


@query("SELECT q AS code, CAST(((q >> 1) & 1) + 2 * ((q >> 4) & 1) + 4 * (q & 1) AS BIGINT) AS gathered, CAST((q & 1) * 8 + ((q >> 1) & 1) * 2 AS BIGINT) AS scattered, CAST(bit_count(q) AS INT) AS ones FROM (SELECT DISTINCT CAST(l_quantity AS INT) - 1 AS q FROM lineitem)")
def bit_gather_scatter(spark, d):
    c = F.col("quantity")
    return star(spark, d, ["quantity"]).select("quantity").distinct().select(c.alias("code"), B.gather(c, [1, 4, 0]).alias("gathered"), B.scatter(c, [3, 1]).alias("scattered"), F.bit_count(c).cast("int").alias("ones"))


# predicates ---------------------------------------------------------------------------------------------------------
@query(STAR + f" SELECT shipyear, {SUM} FROM star WHERE quantity = 16 GROUP BY 1")
def slice_equals(spark, d):
    """The slice reaches the Parquet reader as bounds on the quantity."""
    return C.project(star(spark, d, ["shipyear"], {"quantity": (16, 16)}), ["shipyear"])


@query(STAR + f" SELECT shipyear, {SUM} FROM star WHERE quantity BETWEEN 16 AND 31 GROUP BY 1")
def slice_range(spark, d):
    C.aligned(16, 31)
    return C.project(star(spark, d, ["shipyear"], {"quantity": (16, 31)}), ["shipyear"])


@query(STAR + f" SELECT custregion, {SUM} FROM star WHERE shipyear BETWEEN 1 AND 2 AND discount BETWEEN 2 AND 5 AND custnation BETWEEN 3 AND 12 GROUP BY 1")
def slice_pushed(spark, d):
    """Slices on the fact table and on a lookup, all by bounds on source columns."""
    return C.project(star(spark, d, ["custregion"], {"shipyear": (1, 2), "discount": (2, 5), "custnation": (3, 12)}), ["custregion"])


@query(STAR + f" SELECT returnflag, {SUM} FROM star WHERE (discount = 3 AND tax = 2) OR linestatus = 1 GROUP BY 1")
def slice_and_or(spark, d):
    return C.project(star(spark, d, ["returnflag", "discount", "tax", "linestatus"]).where("(discount = 3 and tax = 2) or linestatus = 1"), ["returnflag"])


@query(STAR + f" SELECT custregion, quantity, {SUM} FROM star WHERE (quantity < 5 OR quantity >= 45) AND (custregion = 1 OR custregion = 3) GROUP BY 1, 2")
def criteria_all(spark, d):
    rows = C.project(star(spark, d, ["custregion", "quantity"]), ["custregion", "quantity"])
    return rows.where(A.criteria({"quantity": ["<5", ">=45"], "custregion": ["1", "3"]}))


@query(STAR + f" SELECT custregion, linenumber, {SUM} FROM star WHERE custregion <> 2 OR linenumber <= 1 GROUP BY 1, 2")
def criteria_any(spark, d):
    rows = C.project(star(spark, d, ["custregion", "linenumber"]), ["custregion", "linenumber"])
    return rows.where(A.criteria({"custregion": ["!2"], "linenumber": ["<=1"]}, any_of=True))


_IDX = "CAST(linestatus + 2 * ((quantity >> 5) & 1) + 4 * ((returnflag >> 1) & 1) + 8 * ((discount >> 3) & 1) AS BIGINT)"


def _cells4(spark, d):
    rows = star(spark, d, ["linestatus", "quantity", "returnflag", "discount"])
    bit = lambda c, b: F.shiftright(F.col(c), b).bitwiseAND(F.lit(1))
    return C.cells(rows, [bit("linestatus", 0), bit("quantity", 5), bit("returnflag", 1), bit("discount", 3)])


@query(STAR + f" SELECT {_IDX} AS idx, {SUM} FROM star GROUP BY 1")
def project_sparse(spark, d):
    return _cells4(spark, d)


@query(STAR + f", c AS (SELECT {_IDX} AS idx, {SUM} FROM star GROUP BY 1) SELECT CAST(range AS BIGINT) AS idx, COALESCE(measure, 0) AS measure FROM range(16) LEFT JOIN c ON idx = range")
def project_dense(spark, d):
    return C.densify(_cells4(spark, d), 4)


@query(STAR + f" SELECT CAST(linestatus + 2 * ((discount >> 3) & 1) AS BIGINT) AS idx, {SUM} FROM star GROUP BY 1")
def project_two_step(spark, d):
    """From a smaller cuboid instead of the base."""
    return _cells4(spark, d).groupBy(B.gather(F.col("idx"), [0, 3]).alias("idx")).agg(F.sum("measure").alias("measure"))


@query(STAR + f" SELECT CAST(linestatus + 2 * ((discount >> 3) & 1) AS BIGINT) AS idx, {SUM} FROM star WHERE ((quantity >> 5) & 1) = 1 AND ((returnflag >> 1) & 1) = 0 GROUP BY 1")
def slice_cells(spark, d):
    return C.slice_cells(_cells4(spark, d), {1: 1, 2: 0}, 4)


@query(STAR + f" SELECT CAST(linestatus + 2 * ((discount >> 3) & 1) AS BIGINT) AS idx, {SUM} FROM star WHERE ((quantity >> 5) & 1) + 2 * ((returnflag >> 1) & 1) IN (1, 2) GROUP BY 1")
def dice_cells(spark, d):
    return C.dice_cells(_cells4(spark, d), [1, 2], [1, 2], 4)


@query(STAR + f" SELECT CAST(((discount >> 3) & 1) + 2 * linestatus + 4 * ((returnflag >> 1) & 1) + 8 * ((quantity >> 5) & 1) AS BIGINT) AS idx, {SUM} FROM star GROUP BY 1 ORDER BY 1")
def permute_cells(spark, d):
    """The same cells in the order in which a user named the bits."""
    return _cells4(spark, d).select(B.gather(F.col("idx"), [3, 0, 2, 1]).alias("idx"), "measure").orderBy("idx")


@query("SELECT CAST(l_linenumber AS INT) AS linenumber, CAST(SUM(CASE WHEN l_linenumber > 5 THEN 0 ELSE 1 END) AS BIGINT) AS measure FROM lineitem GROUP BY 1 HAVING SUM(CASE WHEN l_linenumber > 5 THEN 0 ELSE 1 END) <> 0")
def zero_filter(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("linenumber"), F.when(F.col("l_linenumber") > 5, 0).otherwise(1).cast("long").alias("measure"))
    return C.project(rows, ["linenumber"], keep_zero=False)


@query("SELECT n_nationkey, n_name AS found, ' ' AS missing FROM nation")
def header_value(spark, d):
    n = table(spark, d, "nation").withColumn("h", F.concat(F.lit("key="), F.col("n_nationkey").cast("string"), F.lit(";name="), F.col("n_name")))
    return n.select("n_nationkey", A.value_in_header(F.col("h"), "name").alias("found"), A.value_in_header(F.col("h"), "other").alias("missing"))


# aggregates ---------------------------------------------------------------------------------------------------------
@query(STAR + " SELECT returnflag, linestatus, orderyear, custregion, suppregion, CAST(SUM(measure) AS BIGINT) AS measure, COUNT(*) AS cnt FROM star GROUP BY ALL")
def base_cuboid(spark, d):
    dims = ["returnflag", "linestatus", "orderyear", "custregion", "suppregion"]
    return C.base_cuboid(star(spark, d, dims), dims)


@query(STAR + " SELECT shipyear, linenumber, CAST(SUM(measure) AS BIGINT) AS measure, COUNT(*) AS cnt FROM star GROUP BY ALL")
def incremental_build(spark, d):
    """Parts folded one after another."""
    dims = ["shipyear", "linenumber"]
    rows = star(spark, d, dims)
    parts = [C.base_cuboid(rows.where(F.col("linenumber") % 3 == k), dims) for k in range(3)]
    return C.merged(C.merged(parts[0], parts[1], dims), parts[2], dims)


@query(STAR + f" SELECT returnflag, linestatus, custregion, CAST(GROUPING(returnflag) + 2 * GROUPING(linestatus) + 4 * GROUPING(custregion) AS INT) AS gid, {SUM} FROM star GROUP BY CUBE (returnflag, linestatus, custregion)")
def cube_all_subsets(spark, d):
    dims = ["returnflag", "linestatus", "custregion"]
    return C.all_subsets(star(spark, d, dims), dims)


@query(STAR + f" SELECT orderyear, orderquarter, custregion, CAST(GROUPING(orderyear) + 2 * GROUPING(orderquarter) + 4 * GROUPING(custregion) AS INT) AS gid, {SUM} FROM star GROUP BY GROUPING SETS ((orderyear, orderquarter), (orderyear, custregion), (custregion))")
def cube_chosen_subsets(spark, d):
    dims = ["orderyear", "orderquarter", "custregion"]
    return C.chosen_subsets(star(spark, d, dims), dims, [dims[:2], ["orderyear", "custregion"], ["custregion"]])


@query(STAR + f" SELECT partsize, {SUM} FROM star GROUP BY 1")
def value_distribution(spark, d):
    return C.project(star(spark, d, ["partsize"]), ["partsize"])


@query(STAR + f" SELECT orderyear, orderquarter, ordermonth, CAST(GROUPING(orderyear) + GROUPING(orderquarter) + GROUPING(ordermonth) AS INT) AS level, {SUM} FROM star GROUP BY ROLLUP (orderyear, orderquarter, ordermonth)")
def rollup_dates(spark, d):
    levels = ["orderyear", "orderquarter", "ordermonth"]
    g = sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return star(spark, d, levels).rollup(*levels).agg(F.sum("measure").alias("measure"), g.alias("level"))


@query(STAR + f" SELECT CAST(quantity >> 4 AS INT) AS quantity, CAST(suppregion AS INT) AS suppregion, {SUM} FROM star GROUP BY 1, 2")
def drill_prefix(spark, d):
    return star(spark, d, ["quantity", "suppregion"]).groupBy(B.prefix(F.col("quantity"), 6, 2).alias("quantity"), "suppregion").agg(F.sum("measure").alias("measure"))


@query(STAR + " SELECT x, CAST(SUM(y) AS BIGINT) AS total FROM (SELECT suppregion::VARCHAR AS x, quantity AS y FROM star GROUP BY 1, 2 HAVING SUM(measure) <> 0) GROUP BY 1")
def query_dimension(spark, d):
    rows = star(spark, d, ["suppregion", "quantity"]).withColumn("suppregion", F.col("suppregion").cast("string"))
    return A.query_dimension(rows, "suppregion", F.col("quantity"))


@query(STAR + " SELECT CASE WHEN x < '2' THEN 'low' ELSE 'high' END AS x, CAST(SUM(y) AS BIGINT) AS total FROM (SELECT suppregion::VARCHAR AS x, quantity AS y FROM star GROUP BY 1, 2 HAVING SUM(measure) <> 0) GROUP BY 1")
def query_dimension_grouped(spark, d):
    rows = star(spark, d, ["suppregion", "quantity"]).withColumn("suppregion", F.col("suppregion").cast("string"))
    return A.query_dimension(rows, "suppregion", F.col("quantity"), group=lambda c: F.when(c < "2", "low").otherwise("high"))


_V = "SELECT returnflag, CAST(SUM(quantity + 1) AS BIGINT) t, COUNT(*) c, CAST(SUM((quantity + 1) * (quantity + 1)) AS BIGINT) s FROM star GROUP BY 1"


def _quantity_sums(spark, d):
    q = F.col("quantity") + 1
    return star(spark, d, ["returnflag", "quantity"]).groupBy("returnflag").agg(F.sum(q).alias("t"), F.count("*").alias("c"), F.sum(q * q).alias("s"))


@query(STAR + f" SELECT returnflag, ROUND(t / c, 6) AS mean FROM ({_V})")
def average(spark, d):
    return A.mean(_quantity_sums(spark, d), ["returnflag"], "t", "c").withColumn("mean", F.round("mean", 6))


@query(STAR + f" SELECT returnflag, ROUND(s / c - (t / c) * (t / c), 6) AS variance FROM ({_V})")
def variance(spark, d):
    return A.variance(_quantity_sums(spark, d), ["returnflag"], "s", "t", "c").withColumn("variance", F.round("variance", 6))


@query(STAR + " SELECT shipyear, ROUND((m - AVG(m) OVER ()) / STDDEV_POP(m) OVER (), 6) AS z FROM (SELECT shipyear, CAST(SUM(measure) AS DOUBLE) AS m FROM star GROUP BY 1)")
def normalization(spark, d):
    rows = C.project(star(spark, d, ["shipyear"]), ["shipyear"]).withColumn("m", F.col("measure").cast("double"))
    return A.normalized(rows, "m").select("shipyear", F.round("z", 6).alias("z"))


@query(STAR + " SELECT linestatus, ROUND(regr_slope(y, x), 3) AS slope, ROUND(regr_intercept(y, x), 2) AS intercept FROM (SELECT linestatus, CAST(quantity AS DOUBLE) x, CAST(SUM(measure) AS DOUBLE) / 1000000 y FROM star GROUP BY 1, quantity) GROUP BY 1")
def linear_regression(spark, d):
    rows = C.project(star(spark, d, ["linestatus", "quantity"]), ["linestatus", "quantity"]).select("linestatus", F.col("quantity").cast("double").alias("x"), (F.col("measure").cast("double") / 1000000).alias("y"))
    return A.regression(rows, "x", "y", ["linestatus"]).select("linestatus", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(STAR + " SELECT partsize, bool_or(discount > quantity) AS found FROM star GROUP BY 1")
def exists_reduction(spark, d):
    return A.exists(star(spark, d, ["partsize", "discount", "quantity"]), "discount", "quantity", lambda a, b: a > b, ["partsize"])


@query(STAR + " SELECT partsize, bool_and(tax <= quantity) AS found FROM star GROUP BY 1")
def for_all_reduction(spark, d):
    return A.for_all(star(spark, d, ["partsize", "tax", "quantity"]), "tax", "quantity", lambda a, b: a <= b, ["partsize"])


@query(STAR + """, s AS (SELECT custregion, ordermonth, CAST(SUM(measure) AS BIGINT) v FROM star GROUP BY 1, 2), d AS (SELECT custregion, ordermonth, sign(v - LAG(v) OVER (PARTITION BY custregion ORDER BY ordermonth)) g FROM s),
 t AS (SELECT custregion, CASE WHEN g <> LAG(g) OVER (PARTITION BY custregion ORDER BY ordermonth) THEN 1 ELSE 0 END k FROM d WHERE g <> 0) SELECT custregion, CAST(SUM(k) AS BIGINT) AS breaks, SUM(k) = 0 AS monotone, SUM(k) >= 3 AS double_peak FROM t GROUP BY 1""")
def trend_breaks(spark, d):
    rows = C.project(star(spark, d, ["custregion", "ordermonth"]), ["custregion", "ordermonth"])
    return A.trend_breaks(rows, ["custregion"], "ordermonth")


@query(STAR + ", s AS (SELECT ordermonth, CAST(SUM(measure) AS BIGINT) AS measure FROM star GROUP BY 1) SELECT ordermonth, CAST(SUM(measure) OVER (ORDER BY ordermonth ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS BIGINT) AS window_sum FROM s")
def window_rows(spark, d):
    return A.window_rows(C.project(star(spark, d, ["ordermonth"]), ["ordermonth"]), "ordermonth", 3).select("ordermonth", "window_sum")


@query(STAR + ", s AS (SELECT custregion, quantity, CAST(SUM(measure) AS BIGINT) AS measure FROM star WHERE quantity % 3 <> 1 GROUP BY 1, 2) SELECT custregion, quantity, CAST(SUM(measure) OVER (PARTITION BY custregion ORDER BY quantity RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS window_sum FROM s")
def window_values(spark, d):
    rows = C.project(star(spark, d, ["custregion", "quantity"]).where("quantity % 3 <> 1"), ["custregion", "quantity"])
    return A.window_values(rows, "quantity", 4, by=["custregion"]).select("custregion", "quantity", "window_sum")


@query("SELECT p_size::VARCHAR AS x, COUNT(*) AS n FROM part GROUP BY 1")
def sort_numeric_text(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_size").cast("string").alias("x")).agg(F.count("*").alias("n"))
    return A.by_number(rows, "x")


@query("SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY p_brand LIMIT 5 OFFSET 10")
def page_values(spark, d):
    return A.page(table(spark, d, "part").select("p_brand").distinct(), ["p_brand"], 2, 5)


@query(STAR + ", s AS (SELECT custregion, shipyear, CAST(SUM(measure) AS DOUBLE) v FROM star GROUP BY 1, 2) SELECT custregion, ROUND(-SUM(v / t * LN(v / t)), 6) AS entropy, ROUND(-SUM(v / t * LN(v / t)) / LN(2), 6) AS entropy2 FROM (SELECT *, SUM(v) OVER (PARTITION BY custregion) t FROM s) GROUP BY 1")
def entropy(spark, d):
    rows = C.project(star(spark, d, ["custregion", "shipyear"]), ["custregion", "shipyear"])
    return A.entropy(rows, by=["custregion"]).select("custregion", F.round("entropy", 6).alias("entropy"), F.round("entropy2", 6).alias("entropy2"))


@query(STAR + f", a AS (SELECT CAST(quantity AS BIGINT) idx, {SUM} FROM star GROUP BY 1), b AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN measure - 100 ELSE measure + 50 END AS measure FROM a) SELECT ROUND(SUM(abs(a.measure - b.measure)) / SUM(a.measure), 9) AS l1, CAST(MAX(abs(a.measure - b.measure)) AS BIGINT) AS max_abs FROM a JOIN b USING (idx)")
def error_metrics(spark, d):
    a = C.project(star(spark, d, ["quantity"]), [F.col("quantity").cast("long").alias("idx")])
    b = a.select("idx", F.when(F.col("idx") % 2 == 0, F.col("measure") - 100).otherwise(F.col("measure") + 50).alias("measure"))
    return A.error_metrics(a, b).select(F.round("l1", 9).alias("l1"), "max_abs")


@query("""SELECT CAST(SUM(CASE WHEN NOT a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS neither, CAST(SUM(CASE WHEN NOT a AND b THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(SUM(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS only_a,
 CAST(SUM(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS "both", TRUE AS renamed FROM (SELECT event_id < 500 AS a, event_id >= 500 AS b FROM events)""")
def rename_counts(spark, d):
    old, new = F.when(F.col("event_id") < 500, F.col("user_id")), F.when(F.col("event_id") >= 500, F.col("user_id"))
    rows = table(spark, d, "events").select(old.alias("a"), new.alias("b"))
    return A.rename_counts(rows, F.col("a").isNotNull(), F.col("b").isNotNull(), F.lit(1))


@query("""SELECT 'a' AS "column", CAST(0 AS BIGINT) AS at, 'add' AS event UNION ALL SELECT 'a', 300, 'remove' UNION ALL SELECT 'b', 200, 'add' UNION ALL SELECT 'b', 400, 'remove' UNION ALL SELECT 'b', 450, 'add'""")
def drift_events(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(i < 300, 1).alias("a"), F.when((i >= 200) & ~i.between(400, 449), 1).alias("b"))
    return A.null_changes(rows, "event_id", ["a", "b"])


@query("SELECT CAST(500 AS BIGINT) AS at, 'a' AS old, 'b' AS new FROM (SELECT MAX(event_id) AS last FROM events) WHERE last >= 500")
def drift_renames(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(i < 500, 1).alias("a"), F.when(i >= 500, 1).alias("b"), F.when(i >= 700, 1).alias("c"))
    return A.rename_events(A.null_changes(rows, "event_id", ["a", "b", "c"]))


@query(STAR + ", s AS (SELECT quantity, CAST(SUM(measure) AS BIGINT) AS measure FROM star WHERE quantity % 3 <> 1 GROUP BY 1) SELECT quantity, CAST(SUM(measure) OVER (ORDER BY quantity RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT) AS window_sum FROM s")
def window_values_whole(spark, d):
    """Without a partition: ranges of the dimension."""
    rows = C.project(star(spark, d, ["quantity"]).where("quantity % 3 <> 1"), ["quantity"])
    return A.window_values(rows, "quantity", 4).select("quantity", "window_sum")


@query(STAR + ", s AS (SELECT custregion, shipyear, CAST(SUM(measure) AS DOUBLE) v FROM star GROUP BY 1, 2) SELECT custregion, ROUND(-SUM(v / t * LN(v / t)) / LN(8), 6) AS entropy FROM (SELECT *, SUM(v) OVER (PARTITION BY custregion) t FROM s) GROUP BY 1")
def normalized_entropy(spark, d):
    rows = C.project(star(spark, d, ["custregion", "shipyear"]), ["custregion", "shipyear"])
    return A.normalized_entropy(rows, 8, by=["custregion"]).select("custregion", F.round("entropy", 6).alias("entropy"))


@query("SELECT event_id, FLOOR(value * 100.0) / 100.0 AS cut FROM events")
def floor_digits(spark, d):
    return table(spark, d, "events").select("event_id", A.floor_to(F.col("value"), 2).alias("cut"))


@query("SELECT 'Q' || quarter(o_orderdate)::VARCHAR AS \"Quarter\", 'C' || (o_custkey % 4)::VARCHAR AS \"City\", CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS measure FROM orders GROUP BY 1, 2")
def dataset_sales(spark, d):
    """A declared schema of two texts and a measure."""
    o = table(spark, d, "orders")
    raw = o.select(F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("Quarter"), F.concat(F.lit("C"), F.col("o_custkey") % 4).alias("City"), F.floor("o_totalprice").cast("string").alias("Sale"))
    return datasets.SALES.cube(raw).query({"Quarter": 2, "City": 2})


@query("""SELECT 'N' || n_name AS customer_state, year(o_orderdate) AS year, COUNT(*) AS items, CAST(SUM(CAST(FLOOR(CAST(CAST(l_quantity AS INT) AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS measure
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def dataset_marketplace(spark, d):
    """Order items with their order, customer, product and seller, by four lookups."""
    t = lambda n: table(spark, d, n)
    items = t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_quantity").cast("int").cast("string").alias("price"))
    orders = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp"))
    places = lambda key, rows: rows.withColumns({f"{key}_zip_code_prefix": F.lit("0"), f"{key}_city": F.lit("c")})
    customers = places("customer", t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.concat(F.lit("N"), "n_name").alias("customer_state")))
    products = t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name"))
    sellers = places("seller", t("supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").cast("string").alias("seller_state")))
    rows = datasets.MARKETPLACE.rows(datasets.marketplace(items, orders, customers, products, sellers))
    return rows.groupBy("customer_state", (F.col("`order_purchase_timestamp.year`") + 2016).alias("year")).agg(F.count("*").alias("items"), F.sum("_measure").alias("measure")).select("customer_state", F.col("year").cast("long").alias("year"), "items", "measure")
