"""Cubes, plans and solvers as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellarium.operators import cuboid as C
from cellarium.operators.cube import Cube
from cellarium.plans import index as I
from cellarium.plans import strategies as M
from cellarium.queries.common import STAR, SUM, query
from cellarium.solvers import extrapolate as X
from cellarium.solvers import ipf, linear
from cellarium.solvers import moments as V
from cellarium.sources import workload
from cellarium.sources.star import BY_NAME, star, table
from cellarium.storage import scratch
from cellarium.streaming import ingest, sampling

COLUMNS = ("returnflag", "linestatus", "discount", "quantity", "custregion")


def cube(spark, d, names=COLUMNS) -> Cube:
    rows = star(spark, d, list(names))
    return Cube({n: BY_NAME[n].width for n in names}, C.base_cuboid(rows, list(names)))


def built(spark, d) -> Cube:
    """A cube with its base and sixty-odd prefix cuboids in the shared folder."""
    c = cube(spark, d)
    columns = [c.column_bits(n) for n in c.columns]
    return c.materialize(M.schema_based(columns, 6, 3, 8, seed=4), scratch(spark, "cube"))


#: Returned, open status, high half of the quantities, high discounts: one bit each, numbered as in the cube.
QUERY = {"linestatus": 1, "quantity": 1, "returnflag": 1, "discount": 1}
_IDX = "CAST(((returnflag >> 1) & 1) + 2 * linestatus + 4 * ((discount >> 3) & 1) + 8 * ((quantity >> 5) & 1) AS BIGINT)"
CELLS = STAR + f", cells AS (SELECT {_IDX} AS idx, {SUM} FROM star GROUP BY 1), dense AS (SELECT CAST(range AS BIGINT) AS idx, COALESCE(measure, 0) AS v FROM range(16) LEFT JOIN cells ON idx = range)"


def query_bits(c: Cube) -> list[int]:
    return sorted(b for n, k in QUERY.items() for b in c.prefix_bits(n, k))


def _frame(spark, x, digits: int = 2):
    return spark.createDataFrame([(i, round(float(v), digits)) for i, v in enumerate(x)], "idx long, v double")


def _cells(spark, d):
    c = cube(spark, d)
    return C.dense_array(c.naive(query_bits(c)), 4)


@query(CELLS + " SELECT idx, v AS measure FROM dense")
def naive_from_cuboid(spark, d):
    """An exact answer from the cheapest materialized cuboid that covers the query."""
    c = built(spark, d)
    return c.naive(query_bits(c), dense=True)


@query(CELLS + " SELECT idx, v AS measure FROM dense")
def naive_from_base(spark, d):
    c = cube(spark, d)
    return c.naive(query_bits(c), dense=True)


@query(STAR + " SELECT returnflag, " + ", ".join(f"CAST(SUM(measure) FILTER (custregion = {v}) AS BIGINT) AS \"{v:03b}\"" for v in range(8)) + " FROM star GROUP BY 1")
def pivot(spark, d):
    return cube(spark, d).query({"returnflag": 2}, {"custregion": 3})


@query(STAR + f" SELECT returnflag, CAST(quantity >> 3 AS INT) AS quantity, {SUM} FROM star WHERE discount >= 8 GROUP BY 1, 2")
def query_prefixes(spark, d):
    return cube(spark, d).query({"returnflag": 2, "quantity": 3}, where=F.col("discount") >= 8)


@query(STAR + " SELECT custregion, ROUND(SUM(measure) / COUNT(*), 4) AS measure FROM star WHERE linestatus = 1 GROUP BY 1")
def session_average(spark, d):
    from cellarium.sessions import QuerySession

    s = QuerySession(cube(spark, d))
    s.set_filter("linestatus", [1])
    return s.run({"custregion": 3}, "avg").select("custregion", F.round("measure", 4).alias("measure"))


@query(STAR + " SELECT CAST(SUM(measure) AS BIGINT) AS total, " + ", ".join(f"CAST(SUM(measure * (({n} >> {b}) & 1)) AS BIGINT) AS {n}_{b}" for n in COLUMNS for b in range(BY_NAME[n].width)) + " FROM star")
def primary_moments(spark, d):
    c = cube(spark, d)
    total, ones = c.primary_moments()
    return spark.createDataFrame([(total, *ones)], "total long, " + ", ".join(f"{n}_{b} long" for n, b in c.bits))


@query(CELLS + " SELECT CAST(s.range AS BIGINT) AS idx, CAST(COALESCE(SUM(v) FILTER ((dense.idx & s.range) = s.range), 0) AS DOUBLE) AS v FROM range(16) s, dense GROUP BY 1")
def moments(spark, d):
    return _frame(spark, V.moments(_cells(spark, d)))


@query(CELLS + " SELECT CAST(s.range AS BIGINT) AS idx, CAST(COALESCE(SUM(v) FILTER ((dense.idx & s.range) = 0), 0) AS DOUBLE) AS v FROM range(16) s, dense GROUP BY 1")
def complementary_moments(spark, d):
    return _frame(spark, V.moments0(_cells(spark, d)))


@query(CELLS + " SELECT idx, CAST(v AS DOUBLE) AS v FROM dense")
def moments_inverse(spark, d):
    return _frame(spark, V.values(V.moments(_cells(spark, d))))


@query(CELLS + """, p AS (SELECT SUM(v)::DOUBLE t, SUM(v * (idx & 1))::DOUBLE / SUM(v) p0, SUM(v * ((idx >> 1) & 1))::DOUBLE / SUM(v) p1, SUM(v * ((idx >> 2) & 1))::DOUBLE / SUM(v) p2, SUM(v * ((idx >> 3) & 1))::DOUBLE / SUM(v) p3 FROM dense)
 SELECT CAST(s.range AS BIGINT) AS idx, ROUND(SUM(v * CASE WHEN s.range & 1 = 1 THEN (idx & 1) - p0 ELSE 1 END * CASE WHEN s.range & 2 = 2 THEN ((idx >> 1) & 1) - p1 ELSE 1 END * CASE WHEN s.range & 4 = 4 THEN ((idx >> 2) & 1) - p2 ELSE 1 END * CASE WHEN s.range & 8 = 8 THEN ((idx >> 3) & 1) - p3 ELSE 1 END) / ANY_VALUE(t), 6) + 0.0 AS v FROM range(16) s, dense, p GROUP BY 1""")
def comoments(spark, d):
    x = _cells(spark, d)
    return _frame(spark, V.comoments(x, V.means(x)) / x.sum() + 0.0, 6).withColumn("v", F.col("v") + 0.0)


# three bits, closed form: status, high half of the quantities, returned
_CELLS3 = STAR + """, m AS (SELECT SUM(v)::DOUBLE t, SUM(v*b0)::DOUBLE m1, SUM(v*b1)::DOUBLE m2, SUM(v*b2)::DOUBLE m4, SUM(v*b0*b1)::DOUBLE m3, SUM(v*b0*b2)::DOUBLE m5, SUM(v*b1*b2)::DOUBLE m6
 FROM (SELECT (returnflag >> 1) & 1 b0, linestatus b1, (quantity >> 5) & 1 b2, measure v FROM star)), """
_OUT3 = """ SELECT CAST(0 AS BIGINT) AS idx, ROUND(t-m1-m2-m4+m3+m5+m6-m7, 1) AS v FROM f UNION ALL SELECT 1, ROUND(m1-m3-m5+m7, 1) FROM f UNION ALL SELECT 2, ROUND(m2-m3-m6+m7, 1) FROM f UNION ALL SELECT 3, ROUND(m3-m7, 1) FROM f
 UNION ALL SELECT 4, ROUND(m4-m5-m6+m7, 1) FROM f UNION ALL SELECT 5, ROUND(m5-m7, 1) FROM f UNION ALL SELECT 6, ROUND(m6-m7, 1) FROM f UNION ALL SELECT 7, ROUND(m7, 1) FROM f"""


def _parts3(spark, d):
    c = cube(spark, d)
    q = sorted(b for n in ("linestatus", "quantity", "returnflag") for b in c.prefix_bits(n, 1))
    return X.marginals_of(C.dense_array(c.naive(q), 3), [3, 5, 6])


@query(_CELLS3 + "f AS (SELECT *, m3*m4/t + m5*m2/t + m6*m1/t - 2*m1*m2*m4/(t*t) AS m7 FROM m)" + _OUT3)
def solve_comoment(spark, d):
    s = X.CoMoment(3, handle_negative=False)
    for mask, v in _parts3(spark, d):
        s.add(mask, v)
    return _frame(spark, s.solve(), 1)


@query(_CELLS3 + "f AS (SELECT *, 0.0 AS m7 FROM m)" + _OUT3)
def solve_zero(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "zero"), 1)


@query(_CELLS3 + "f AS (SELECT *, t / 8 AS m7 FROM m)" + _OUT3)
def solve_half_power(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "half_power"), 1)


@query(_CELLS3 + "f AS (SELECT *, (m3 + m5 + m6) / 6 AS m7 FROM m)" + _OUT3)
def solve_avg(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "avg"), 1)


@query(_CELLS3 + "f AS (SELECT *, LEAST(m3, m5, m6) AS m7 FROM m)" + _OUT3)
def solve_frechet_upper(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "frechet_upper"), 1)


@query(_CELLS3 + "f AS (SELECT *, (LEAST(m3, m5, m6) + GREATEST(0, m3+m5-m1, m3+m6-m2, m5+m6-m4)) / 2 AS m7 FROM m)" + _OUT3)
def solve_frechet_mid(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "frechet_mid"), 1)


@query(_CELLS3 + "f AS (SELECT *, m1*m2*m4/(t*t) AS m7 FROM m)" + _OUT3)
def solve_mean_product(spark, d):
    return _frame(spark, X.solve(3, _parts3(spark, d), "mean_product"), 1)


@query(CELLS + """, p AS (SELECT SUM(v)::DOUBLE t, SUM(v * (idx & 1))::DOUBLE / SUM(v) p0, SUM(v * ((idx >> 1) & 1))::DOUBLE / SUM(v) p1, SUM(v * ((idx >> 2) & 1))::DOUBLE / SUM(v) p2, SUM(v * ((idx >> 3) & 1))::DOUBLE / SUM(v) p3 FROM dense)
 SELECT idx, ROUND(t * CASE WHEN idx & 1 = 1 THEN p0 ELSE 1 - p0 END * CASE WHEN idx & 2 = 2 THEN p1 ELSE 1 - p1 END * CASE WHEN idx & 4 = 4 THEN p2 ELSE 1 - p2 END * CASE WHEN idx & 8 = 8 THEN p3 ELSE 1 - p3 END, 1) AS v FROM dense, p""")
def solve_product(spark, d):
    total, ones = V.primary(_cells(spark, d))
    return _frame(spark, X.one_d_product(4, total, ones), 1)


@query()
def sampling_solvers(spark, d):
    """A sample alone, with known central moments, and as the start of a fit."""
    c = cube(spark, d)
    q = query_bits(c)
    x = C.dense_array(c.naive(q), len(q))
    s, scale = sampling.naive(c.base, list(c.columns), [c.bit_column(b) for b in q], 0.3)
    parts = X.marginals_of(x, [3, 6, 12])
    runs = {"naive": s * scale, "moments": X.sampled(4, s, scale, parts), "primary": X.sampled(4, s, scale, (), V.primary(x)), "sample_means": X.sampled(4, s, scale, parts, means="sample"), "fitted": ipf.fitted_sample(4, s, parts, float(x.sum())), "fitted_plain": ipf.fitted_sample(4, s, parts, float(x.sum()), smooth=False)}
    return spark.createDataFrame([(n, V.l1_error(x, y)) for n, y in runs.items()], "solver string, l1 double")


@query("SELECT event_type, CAST(hour(ts) AS INT) AS hour, CAST(SUM(CAST(FLOOR(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS measure, COUNT(*) AS cnt FROM events GROUP BY 1, 2")
def streaming_ingest(spark, d):
    path = scratch(spark, "ingest")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    ingest.ingest(stream, {"event_type": F.col("event_type"), "hour": F.hour("ts")}, F.floor(F.col("value") * 100 + 0.5).cast("long"), f"{path}/parts", f"{path}/checkpoint")
    return ingest.base(spark, f"{path}/parts", ["event_type", "hour"])


@query("SELECT * FROM (VALUES (3, 32), (4, 16), (5, 8), (6, 4)) t(d, n)")
def strategy_counts(spark, d):
    return spark.createDataFrame(sorted(M.base2_counts(16, 6, 3, 6).items()), "d int, n int")


@query(STAR + f" SELECT CAST(0 AS INT) AS query, CAST(((returnflag >> 1) & 1) + 2 * linestatus AS BIGINT) AS idx, {SUM} FROM star GROUP BY 2 UNION ALL SELECT 1, CAST(quantity >> 4 AS BIGINT), {SUM} FROM star GROUP BY 2")
def workload_truth(spark, d):
    c = cube(spark, d)
    return workload.true_results(c, [[*c.prefix_bits("returnflag", 1), *c.prefix_bits("linestatus", 1)], c.prefix_bits("quantity", 2)])


@query("SELECT CAST(idx AS BIGINT) AS idx, ROUND(v, 1) AS v FROM (" + _CELLS3 + "f AS (SELECT *, m3*m4/t + m5*m2/t + m6*m1/t - 2*m1*m2*m4/(t*t) AS m7 FROM m) SELECT 0 AS idx, m1-m3-m5+m7 AS v FROM f UNION ALL SELECT 1, m5-m7 FROM f)")
def solve_slice(spark, d):
    """Only the cells with the first bit set and the second not."""
    s = X.CoMoment(3, handle_negative=False)
    for mask, v in _parts3(spark, d):
        s.add(mask, v)
    return _frame(spark, s.solve_slice({0: 1, 1: 0}), 1)


def _events(spark, d):
    from cellarium.operators.user import UserCube

    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"), F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") % 8).cast("int").alias("u"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    return UserCube.from_rows(e, "cents")


_EVENTS = "WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) k, CAST(CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 8 END AS INT) u, CAST(FLOOR(value * 100 + 0.5) AS BIGINT) measure FROM events)"


@query(_EVENTS + f" SELECT event_type, (CAST(k >> 4 AS INT) * 16)::VARCHAR || ' to ' || (CAST(k >> 4 AS INT) * 16 + 15)::VARCHAR AS k, {SUM} FROM e GROUP BY 1, 2 HAVING SUM(measure) <> 0")
def user_tuples(spark, d):
    """Labels of prefixes of an inferred schema."""
    return _events(spark, d).query({"event_type": 3, "k": 3})


@query(_EVENTS + f" SELECT event_type, u::VARCHAR AS u, {SUM} FROM (SELECT event_type, COALESCE(u, 0) u, measure FROM e) WHERE u IN (3, 5) AND event_type <> (SELECT MIN(event_type) FROM events) GROUP BY 1, 2 HAVING SUM(measure) <> 0")
def user_criteria(spark, d):
    first = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return _events(spark, d).query({"event_type": 3, "u": 3}, where={"u": ["3", "5"], "event_type": [f"!{first}"]})


@query(_EVENTS + f", m AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS c, measure FROM e) SELECT CAST((c >> 2) & 1 AS INT) AS b2, CAST((c >> 1) & 1 AS INT) AS b1, {SUM} FROM m GROUP BY 1, 2 HAVING SUM(measure) <> 0")
def user_bits(spark, d):
    return _events(spark, d).query({"event_type": 2}, form="bits")


@query(_EVENTS + """ SELECT event_type, CAST(SUM(measure) FILTER (u IS NULL) AS BIGINT) AS "u?=0", CAST(SUM(measure) FILTER (u IS NOT NULL) AS BIGINT) AS "u?=1" FROM e GROUP BY 1""")
def user_matrix(spark, d):
    """A pivot over the not-null bit."""
    return _events(spark, d).query({"event_type": 3}, {"u?": 1}, form="matrix")


@query(_EVENTS + " SELECT x, CAST(SUM(y) AS BIGINT) AS total FROM (SELECT event_type AS x, COALESCE(u, 0) AS y FROM e GROUP BY 1, 2 HAVING SUM(measure) <> 0) GROUP BY 1")
def user_query_dimension(spark, d):
    return _events(spark, d).query_dimension("event_type", "u")


@query(STAR + ", s AS (SELECT ((returnflag >> 1) & 1) + 2 * linestatus + 4 * ((discount >> 3) & 1) AS own, measure FROM star) SELECT CAST(m.range AS BIGINT) AS mask, CAST(SUM(measure) AS BIGINT) AS value FROM range(8) m, s WHERE (own & m.range) = m.range AND bit_count(m.range) <= 2 GROUP BY 1")
def moment_store(spark, d):
    from cellarium.operators import moment_store as S

    c = cube(spark, d)
    return S.build(c, [*c.prefix_bits("returnflag", 1), *c.prefix_bits("linestatus", 1), *c.prefix_bits("discount", 1)], 2)


@query()
def fetch_statistics(spark, d):
    """How many bits the projections of a workload's plans share with their queries."""
    c = cube(spark, d)
    c = Cube(c.columns, c.base, M.schema_based([c.column_bits(n) for n in c.columns], 6, 3, 8, seed=4))
    found = [(len(q), f.covered.bit_count(), f.cost) for q in workload.generate(c, [4, 6], 10, seed=1) for f in c.index.prepare_batch(q)]
    return spark.createDataFrame(found, "q int, covered int, cost int").groupBy("q", "covered").agg(F.count("*").alias("fetches"), F.avg("cost").alias("cost"))


@query()
def shuffled_group(spark, d):
    """The third group of about 64 rows of the shuffled base cuboid."""
    c = cube(spark, d)
    return sampling.group(sampling.shuffled(c.base, list(c.columns)), c.base.count(), 2)


# closed forms ---------------------------------------------------------------------------------------------------------
_G = STAR + """, g AS (SELECT CAST(r.range AS BIGINT) AS idx, r.range & 1 AS a, (r.range >> 1) & 1 AS b, (r.range >> 2) & 1 AS c, CAST(COALESCE(s.v, 0) AS DOUBLE) AS v
 FROM range(8) r LEFT JOIN (SELECT ((returnflag >> 1) & 1) + 2 * linestatus + 4 * ((quantity >> 5) & 1) AS k, SUM(measure) AS v FROM star GROUP BY 1) s ON s.k = r.range)"""


def _bits3(c: Cube) -> list[int]:
    return sorted(b for n in ("linestatus", "quantity", "returnflag") for b in c.prefix_bits(n, 1))


def _exact3(spark, d):
    c = cube(spark, d)
    return C.dense_array(c.naive(_bits3(c)), 3)


def _rows(spark, found: dict, digits: int = 0):
    return spark.createDataFrame([(n, i, round(float(v), digits) + 0.0) for n, x in found.items() for i, v in enumerate(x)], "solver string, idx long, v double")


_STRATEGIES = {
    "avg": "(m3 + m5 + m6) / 6", "avg2": "(t * 0.125 + (m1 + m2 + m4) * 0.5 + (m3 + m5 + m6) * 2) / 19", "cumulant": "co", "comoment": "co", "comoment_frechet": "LEAST(GREATEST(co, lo), GREATEST(lo, hi))",
    "mean_product": "m1*m2*m4/(t*t)", "zero": "0.0", "half_power": "t / 8", "frechet_upper": "hi", "frechet_mid": "(lo + hi) / 2", "low_variance": "LEAST(GREATEST(t / 8, lo), GREATEST(lo, hi))", "error bound": "hi - lo",
}


@query(_CELLS3 + "f AS (SELECT *, m3*m4/t + m5*m2/t + m6*m1/t - 2*m1*m2*m4/(t*t) AS co, GREATEST(0, m3+m5-m1, m3+m6-m2, m5+m6-m4) AS lo, LEAST(m3, m5, m6) AS hi FROM m) " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, ROUND({e}, 1) AS m7 FROM f" for n, e in _STRATEGIES.items()))
def solve_strategies(spark, d):
    """The moment of three bits that every strategy extrapolates from those of pairs, and the bound of its error."""
    parts = _parts3(spark, d)
    rows = [(s, round(float(X.extrapolated(3, parts, s)[7]), 1)) for s in X.STRATEGIES] + [("error bound", round(float(X.error_bound(3, parts)), 1))]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "strategy string, m7 double")


@query(_G + ", t AS (SELECT SUM(v) AS t FROM g) SELECT idx, ROUND((SUM(v) OVER (PARTITION BY a, b) * SUM(v) OVER (PARTITION BY c) + SUM(v) OVER (PARTITION BY a, c) * SUM(v) OVER (PARTITION BY b) + SUM(v) OVER (PARTITION BY b, c) * SUM(v) OVER (PARTITION BY a)) / (3 * t), 0) AS v FROM g, t")
def solve_average(spark, d):
    x = _exact3(spark, d)
    return _frame(spark, X.average(3, X.marginals_of(x, [3, 5, 6]), *V.primary(x)), 0)


_FITTED = ("vanilla", "tree_ordered", "effective", "loopy", "loopy_buckets", "online")


@query(_G + ", f AS (SELECT idx, SUM(v) OVER (PARTITION BY a, b) * SUM(v) OVER (PARTITION BY b, c) / NULLIF(SUM(v) OVER (PARTITION BY b), 0) AS v FROM g) SELECT solver, idx, ROUND(COALESCE(v, 0), 0) AS v FROM f, (VALUES " + ", ".join(f"('{n}')" for n in _FITTED) + ") s(solver)")
def solve_ipf(spark, d):
    """Every kind of fitting to a chain of two marginals, whose fit is known: their product over what they share."""
    x = _exact3(spark, d)
    parts, online = X.marginals_of(x, [3, 6]), ipf.Online(3, *V.primary(x))
    for p in parts:
        online.add(*p)
    found = [ipf.vanilla(3, parts), ipf.tree_ordered(3, parts), ipf.effective(3, parts), ipf.loopy(3, parts), ipf.loopy(3, parts, cliques_by="buckets"), online.x]
    return _rows(spark, dict(zip(_FITTED, found, strict=True)))


@query()
def solve_ipf_loops(spark, d):
    """Fitting to marginals with a loop, and with some left out: errors against the exact answer."""
    x = _cells(spark, d)
    parts = X.marginals_of(x, [3, 6, 12, 9])
    runs = {"vanilla": ipf.vanilla, "effective": ipf.effective, "dropout_dimension": lambda q, p: ipf.dropout(q, p, "dimension"), "dropout_entropy": lambda q, p: ipf.dropout(q, p, "entropy"), "loopy": ipf.loopy}
    return spark.createDataFrame([(n, V.l1_error(x, f(4, parts))) for n, f in runs.items()], "solver string, l1 double")


@query(_G + ", e AS (SELECT idx, SUM(v) OVER (PARTITION BY a, b) AS x, SUM(v) OVER (PARTITION BY c) AS y, SUM(v) OVER () AS t FROM g) SELECT solver, idx, ROUND(GREATEST(0, x + y - t), 0) AS low, ROUND(LEAST(x, y), 0) AS high FROM e, (VALUES ('exact'), ('dual'), ('dense')) s(solver)")
def solve_bounds(spark, d):
    """Bounds of each cell by exact, dual and dense programs, from marginals that share no bit."""
    x = _exact3(spark, d)
    parts = [(m, [int(a) for a in v]) for m, v in X.marginals_of(x, [3, 4])]
    b = linear.Bounds(3)
    for mask, v in parts:
        b.add(mask, v)
    dual = linear.DualSimplex(b.rows, 8)
    found = {"exact": [(c.low, c.high) for c in b.tighten()], "dual": [(dual.least(i), dual.most(i, int(x.sum()))) for i in range(8)], "dense": linear.dense_bounds(3, parts)}
    rows = [(n, i, round(float(lo)) + 0.0, round(float(hi)) + 0.0) for n, v in found.items() for i, (lo, hi) in enumerate(v)]
    return spark.createDataFrame(rows, "solver string, idx long, low double, high double")


def _preset(spark, d, sets, path: str | None = None) -> Cube:
    """A cube whose cuboids have the given sets of the three bits."""
    c = cube(spark, d)
    b = _bits3(c)
    return c.materialize(M.preset(c.n_bits, [[b[i] for i in s] for s in sets]), path or scratch(spark, "cube"))


_PAIRS = [(0, 1), (0, 2), (1, 2)]


@query(_CELLS3 + "f AS (SELECT *, m3*m4/t + m5*m2/t + m6*m1/t - 2*m1*m2*m4/(t*t) AS m7 FROM m)" + _OUT3)
def solve_batch(spark, d):
    """An approximate answer from the catalog's cuboids, none of which covers the query."""
    c = _preset(spark, d, _PAIRS)
    return _frame(spark, c.solve(_bits3(c), primary=c.primary_moments()), 1)


@query(_CELLS3 + "f AS (SELECT *, m3*m4/t + m5*m2/t + m6*m1/t - 2*m1*m2*m4/(t*t) AS m7 FROM m)" + _OUT3)
def solve_from_store(spark, d):
    """The same answer as from marginals, from stored moments."""
    from cellarium.operators import moment_store as S

    c = cube(spark, d)
    return _frame(spark, S.solve(S.build(c, _bits3(c), 2), range(3), 2), 1)


@query(_G + " SELECT idx, ROUND(v, 0) AS v FROM g")
def online_moments(spark, d):
    """A progressive answer's last step, which has the base cuboid, is exact."""
    c = _preset(spark, d, _PAIRS)
    *_, (_, x) = c.online(_bits3(c), primary=c.primary_moments())
    return _frame(spark, x, 0)


@query(_G + " SELECT idx, ROUND(v, 0) AS low, ROUND(v, 0) AS high FROM g")
def online_bounds(spark, d):
    """Progressive bounds end at the exact values."""
    c = _preset(spark, d, _PAIRS)
    *_, b = c.online_bounds(_bits3(c))
    return spark.createDataFrame([(i, float(x.low), float(x.high)) for i, x in enumerate(b.cells)], "idx long, low double, high double")


@query(CELLS + " SELECT idx, CAST(v AS DOUBLE) AS v FROM dense")
def sampling_online(spark, d):
    """Progressive samples end at the exact answer."""
    c = cube(spark, d)
    *_, (_, x) = sampling.online(c.base, list(c.columns), [c.bit_column(b) for b in query_bits(c)])
    return _frame(spark, x)


@query(_G + " SELECT CAST(a AS BIGINT) AS idx, CAST(SUM(v) AS BIGINT) AS measure FROM g WHERE b = 1 GROUP BY 1")
def slice_from_cuboid(spark, d):
    """A slice from the cheapest cuboid that has the sliced bits too."""
    c = _preset(spark, d, _PAIRS)
    b = _bits3(c)
    return c.naive([b[0]], dense=True, fixed={b[1]: 1})


@query(_G + " SELECT idx, CAST(v AS BIGINT) AS measure FROM g")
def materialize_again(spark, d):
    """A second build in the same place leaves answers as they are; the first one's files can go."""
    path = scratch(spark, "cube")
    _preset(spark, d, [(0, 1, 2), *_PAIRS], path)
    c = _preset(spark, d, [(0, 1, 2), *_PAIRS], path)
    Cube.vacuum(spark, path)
    return Cube.load(spark, path).naive(_bits3(c), dense=True)


@query(STAR + " SELECT CAST(linestatus AS BIGINT) AS idx, CAST(SUM(measure) AS DOUBLE) AS v FROM star WHERE returnflag = 2 GROUP BY 1")
def session_progressive(spark, d):
    """A progressive session under a filter: the last step is exact."""
    from cellarium.sessions import QuerySession

    s = QuerySession(_preset(spark, d, _PAIRS))
    s.set_filter("returnflag", [2])
    last = s.start({"linestatus": 1}, s.cube.primary_moments())
    while (step := s.next()) is not None:
        last = step
    return _frame(spark, last[1], 0)


@query("SELECT CAST((event_id + 5000000000) // 16384 AS BIGINT) AS code, COUNT(*) AS measure FROM events GROUP BY 1")
def wide_codes(spark, d):
    """Numbers beyond 32 bits as codes: sums by a prefix."""
    from cellarium.operators.user import UserCube

    c = UserCube.from_rows(table(spark, d, "events").select((F.col("event_id") + 5000000000).alias("n"))).cube
    return c.query({"n": c.columns["n"] - 14}).select(F.col("n").alias("code"), "measure")


@query(_EVENTS + f" SELECT event_type, {SUM} FROM e WHERE k < 30 AND u IN (3, 5) GROUP BY 1 HAVING SUM(measure) <> 0")
def user_criteria_elsewhere(spark, d):
    """Criteria on columns that are no axes."""
    return _events(spark, d).query({"event_type": 3}, where={"k": ["<30"], "u": ["3", "5"]})


# plans and strategies -------------------------------------------------------------------------------------------------
def _choose(n: str, k: str) -> str:
    f = "factorial(CAST({} AS INT))".format
    return f"CAST({f(n)} / ({f(k)} * {f(f'{n} - {k}')}) AS BIGINT)"


_WIDTHS = [3, 2, 4, 1]
_PREFIXES = "SELECT a.range + b.range + c.range + e.range AS d, COUNT(*) AS n FROM range(4) a, range(3) b, range(5) c, range(2) e GROUP BY 1"
_SETS = f"""SELECT 'randomized' AS strategy, CAST(range AS INT) AS bits, LEAST(CAST(POWER(2, 5 - range) AS BIGINT), {_choose('10', 'range')}) AS n FROM range(2, 6)
 UNION ALL SELECT 'schema_based', CAST(d AS INT), LEAST(CAST(POWER(2, 5 - d) AS BIGINT), n) FROM ({_PREFIXES}) WHERE d BETWEEN 2 AND 5
 UNION ALL SELECT 'single', 3, LEAST(16, {_choose('10', '3')}) UNION ALL SELECT 'budgeted', 3, LEAST(CAST(FLOOR(0.25 * POWER(2, 12) / POWER(2, 6) * CEIL(74 / 8)) AS BIGINT), {_choose('10', '3')})
 UNION ALL SELECT 'subsets', CAST(range AS INT), {_choose('3', 'range')} FROM range(4)
 UNION ALL SELECT 'all_or_nothing', CAST(w AS INT), COUNT(*) FROM (SELECT 3 * (range & 1) + 2 * ((range >> 1) & 1) + 4 * ((range >> 2) & 1) + ((range >> 3) & 1) AS w FROM range(1, 16)) WHERE w BETWEEN 3 AND 7 GROUP BY w
 UNION ALL SELECT 'old', CAST(range AS INT), LEAST(CAST(FLOOR(0.1 * POWER(1.2, 10 - range)) AS BIGINT), {_choose('10', 'range')}) FROM range(10) WHERE FLOOR(0.1 * POWER(1.2, 10 - range)) >= 1"""


@query(_SETS + " UNION ALL SELECT strategy, 10, 1 FROM (VALUES ('randomized'), ('schema_based'), ('single'), ('budgeted'), ('subsets'), ('all_or_nothing'), ('old'), ('base')) t(strategy)")
def strategy_sets(spark, d):
    """How many sets of each size the strategies choose."""
    edges = [sum(_WIDTHS[:i]) for i in range(5)]
    columns = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    runs = {"randomized": M.randomized(10, 4, 2, 5), "schema_based": M.schema_based(columns, 4, 2, 5), "old": M.old_randomized(10, 0.1, 1.2), "single": M.single_size(10, 4, 3), "budgeted": M.budgeted(10, 12, 3, 0.25), "all_or_nothing": M.all_or_nothing(columns, 7), "base": M.only_base(10), "subsets": M.all_subsets_of(10, [1, 5, 9])}
    return spark.createDataFrame([(n, len(s)) for n, sets in runs.items() for s in sets], "strategy string, bits int").groupBy("strategy", "bits").agg(F.count("*").alias("n"))


def _values(sets) -> str:
    return "(VALUES " + ", ".join(f"({i}, {sum(1 << b for b in x)}::BIGINT, {len(x)})" for i, x in enumerate(sets)) + ") t(i, m, cost)"


_PLAN_SETS, _PLAN_QUERY = M.randomized(12, 7, 2, 6, seed=1), [1, 4, 7, 10]
_PLAN = f"""WITH p AS (SELECT m & {sum(1 << b for b in _PLAN_QUERY)} AS own, ARG_MIN(i, cost * 1000 + i) AS cuboid, MIN(cost) AS cost FROM {_values(_PLAN_SETS)} GROUP BY 1),
 parts AS (SELECT CAST({' + '.join(f'((own >> {b}) & 1) * {1 << i}' for i, b in enumerate(_PLAN_QUERY))} AS INT) AS covered, CAST(cuboid AS INT) AS cuboid, CAST(cost AS INT) AS cost FROM p),
 small AS (SELECT * FROM (SELECT m & {sum(1 << b for b in _PLAN_QUERY)} AS own, ARG_MIN(i, cost * 1000 + i) AS cuboid, MIN(cost) AS cost FROM {_values(_PLAN_SETS)} WHERE cost < 12 GROUP BY 1)),
 batch AS (SELECT CAST({' + '.join(f'((own >> {b}) & 1) * {1 << i}' for i, b in enumerate(_PLAN_QUERY))} AS INT) AS covered, CAST(cuboid AS INT) AS cuboid, CAST(cost AS INT) AS cost FROM small)
 SELECT 'naive' AS plan, CAST(0 AS INT) AS step, covered, cuboid, cost FROM parts WHERE covered = 15
 UNION ALL SELECT 'batch', CAST(row_number() OVER (ORDER BY bit_count(covered) DESC, cost DESC, covered DESC) - 1 AS INT), covered, cuboid, cost FROM batch x WHERE NOT EXISTS (SELECT 1 FROM batch y WHERE y.covered <> x.covered AND y.covered & x.covered = x.covered)
 UNION ALL SELECT 'online', CAST(row_number() OVER (ORDER BY bit_count(covered), cost, covered) - 1 AS INT), covered, cuboid, cost FROM parts x WHERE NOT EXISTS (SELECT 1 FROM parts y WHERE y.covered <> x.covered AND y.covered & x.covered = x.covered AND (y.cost <= x.cost OR y.cost <= 2))"""


@query(_PLAN)
def prepare_plans(spark, d):
    """Which cuboids a query's plans name."""
    ix = I.CuboidIndex(_PLAN_SETS, 12)
    plans = {"naive": [ix.prepare_naive(_PLAN_QUERY)], "batch": ix.prepare_batch(_PLAN_QUERY), "online": ix.prepare_online(_PLAN_QUERY, 2)}
    return spark.createDataFrame([(n, i, f.covered, f.cuboid, f.cost) for n, p in plans.items() for i, f in enumerate(p)], "plan string, step int, covered int, cuboid int, cost int")


_BUILD_SETS = M.randomized(10, 6, 2, 5, seed=2)


@query(f"""WITH s AS (SELECT * FROM {_values(_BUILD_SETS)}), n AS (SELECT MAX(i) AS last FROM s) SELECT *, parent AS trie FROM (SELECT CAST(x.i AS INT) AS cuboid, CAST(x.cost AS INT) AS n_bits,
 CAST(COALESCE((SELECT ARG_MIN(y.i, y.cost * 1000 + y.i) FROM s y WHERE y.i <> x.i AND y.m & x.m = x.m AND (y.cost > x.cost OR y.i > x.i)), -1) AS INT) AS parent,
 CAST(CASE WHEN x.i < last THEN last ELSE -1 END AS INT) AS base, CAST(COALESCE((SELECT MIN(y.i) FROM s y WHERE y.i > x.i AND y.m & x.m = x.m), -1) AS INT) AS first FROM s x, n)""")
def build_plan(spark, d):
    plans = zip(_BUILD_SETS, I.parents(_BUILD_SETS), I.parents_base(_BUILD_SETS), I.parents_first(_BUILD_SETS), I.parents_trie(_BUILD_SETS), strict=True)
    return spark.createDataFrame([(i, len(s), p, b, f, t) for i, (s, p, b, f, t) in enumerate(plans)], "cuboid int, n_bits int, parent int, base int, first int, trie int")


@query("SELECT CAST(range AS INT) AS query, CAST(2 + 2 * (range // 5) AS INT) AS n_bits, TRUE AS prefixes FROM range(15)")
def workload_generate(spark, d):
    """Queries of the sizes asked for, each of prefixes of columns."""
    c = cube(spark, d)
    prefixes = lambda q: all({b for b in q if b in own} == set(own[len(own) - len(set(q) & set(own)) :]) for own in map(c.column_bits, c.columns))
    return spark.createDataFrame([(i, len(q), prefixes(q)) for i, q in enumerate(workload.generate(c, [2, 4, 6], 5, seed=3))], "query int, n_bits int, prefixes boolean")


@query(STAR + """ SELECT CAST(n_bits AS INT) AS n_bits, COUNT(*) AS cuboids, CAST(SUM(cells) AS BIGINT) AS cells FROM (SELECT 2 AS n_bits, COUNT(DISTINCT returnflag) AS cells FROM star
 UNION ALL SELECT 4, COUNT(DISTINCT discount) FROM star UNION ALL SELECT 6, COUNT(DISTINCT returnflag * 100 + discount) FROM star UNION ALL SELECT 6, COUNT(DISTINCT quantity) FROM star) GROUP BY 1""")
def storage_statistics(spark, d):
    """Rows of the materialized cuboids by number of dimensions."""
    c = cube(spark, d)
    bits = {n: c.column_bits(n) for n in c.columns}
    c = c.materialize(M.preset(c.n_bits, [bits["returnflag"], bits["discount"], bits["returnflag"] + bits["discount"], bits["quantity"]]), scratch(spark, "cube"))
    dims = spark.createDataFrame([(i, len(s)) for i, s in enumerate(c.sets)], "cuboid_id int, n_bits int")
    rows = c.cuboids().groupBy("cuboid_id").agg(F.count("*").alias("n"))
    return rows.join(dims, "cuboid_id").groupBy("n_bits").agg(F.count("*").alias("cuboids"), F.sum("n").alias("cells"))


@query(STAR + " SELECT CAST(SUM(measure) AS BIGINT) AS total, CAST(SUM(measure * linestatus) AS BIGINT) AS linestatus FROM star")
def primary_moments_saved(spark, d):
    """Primary moments from where they were saved."""
    c = cube(spark, d)
    path = scratch(spark, "moments")
    c.save_primary_moments(path)
    total, ones = Cube.load_primary_moments(spark, path)
    return spark.createDataFrame([(total, ones[c.at["linestatus", 0]])], "total long, linestatus long")
