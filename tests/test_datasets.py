import pytest
from pyspark.sql import functions as F

from cellarium.sources import datasets as D
from cellarium.sources import generators as G
from cellarium.sources import workload


def test_small_table(spark):
    raw = spark.createDataFrame([("Q1", "Geneva", "3"), ("Q1", "Bern", "2"), ("Q4", "Geneva", "5"), ("Q2", "Zurich", None), ("Q2", "Lausanne", "1")], "Quarter string, City string, Sale string")
    cube = D.SALES.cube(raw)
    got = {r["City"]: r["measure"] for r in cube.query({"City": cube.cube.columns["City"]}).collect()}
    assert got == {"Geneva": 8, "Bern": 2, "Lausanne": 1}
    assert {r["Quarter"]: r["measure"] for r in cube.query({"Quarter": 2}, where={"City": ["Geneva"]}).collect()} == {"Q1": 3, "Q4": 5}


@pytest.mark.parametrize("dataset", [D.WEBSHOP, D.PARKING, D.FLIGHTS, D.MARKETPLACE, D.ORDER_LINES])
def test_declared_schemas(spark, dataset):
    """Rows of texts, as files give them, become typed columns; what can't be read is missing."""
    when = {"MM/dd/yyyy": "07/04/2015", "yyyyMMdd": "20150704", "yyyy": "2015", "HHmm": "0930", "yyyy-MM-dd HH:mm:ss": "2017-03-05 10:20:30"}
    good = {n: "7.9" if k == "whole" else "abc" if k == "text" else when[k[0]] for n, k in dataset.columns}
    bad = {n: "" for n, _ in dataset.columns}
    extra = {"price_total": "12.34", "price": "5.5", "discount": "10", "tax": "5", "extended_price": "1000"}
    good |= {c: v for c, v in extra.items() if dataset.measure and c in dataset.measure}
    bad |= {c: None for c in extra if dataset.measure and c in dataset.measure and c not in bad}
    names = list(good)
    raw = spark.createDataFrame([tuple(good[n] for n in names), tuple(bad.get(n) for n in names)], ", ".join(f"`{n}` string" for n in names))
    a, b = dataset.rows(raw).collect()
    assert all(v is not None for v in a) and all(v is None for c, v in b.asDict().items() if c != "_measure")
    assert (a["_measure"], b["_measure"]) == {"webshop": (1234, 0), "parking tickets": (1, 1), "flights": (1, 1), "marketplace orders": (550, 0), "order lines": (1000 * 90 * 105 // 10000, 0)}[dataset.name]
    assert len({n for n, _ in dataset.columns}) == len(dataset.columns)


def test_lookups_fail_on_missing_keys(spark, tmp_path):
    facts, names = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    assert sorted((r["v"], r["name"]) for r in D.looked_up(facts, [(names, "k")]).collect()) == [(5, "a"), (6, "b")]
    with pytest.raises(Exception, match="no row with k"):
        D.looked_up(facts.unionAll(spark.createDataFrame([(3, 7)], facts.schema)), [(names, "k")]).collect()


def test_order_lines_files(spark, tmp_path):
    (tmp_path / "lineorder.000.tbl").write_text("1|1|7|8|9|19940102|1-URGENT|0|3|1000|0|10|0|0|5|19940103|AIR|\n")
    (tmp_path / "customer.tbl").write_text("7|n|a|CITY1|NATION|REGION|p|SEG|\n")
    (tmp_path / "supplier.tbl").write_text("9|n|a|CITY2|N2|R2|p|\n")
    (tmp_path / "part.tbl").write_text("8|n|M1|C1|B1|red|T1|4|BOX|\n")
    r = D.ORDER_LINES.rows(D.order_lines(spark, str(tmp_path))).first()
    assert (r["cust_city"], r["supp_city"], r["brand"], r["size"], r["_measure"], r["order_date.year"], r["order_date.day"]) == ("CITY1", "CITY2", "B1", 4, 9450 // 10, 24, 1)


def test_samples(spark):
    df = spark.range(0, 100, 1, 5)
    assert D.sample_of_parts(df, 3).count() == 15


def test_typed_drift():
    rows = G.drifting_records(300, ["a", "b"], seed=2, types={"a": "text", "b": "date"})
    assert all(isinstance(r["a"], str) for r in rows if "a" in r) and len({k for r in rows for k in r}) > 5
    assert {type(v).__name__ for r in rows for v in r.values()} >= {"str", "int"}


def test_workload_round_trip(spark, tmp_path):
    results = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], "query int, idx long, measure long")
    workload.save(results, str(tmp_path / "w"), [(1, 2), (3,)])
    queries, back = workload.load(spark, str(tmp_path / "w"))
    assert queries == [(1, 2), (3,)] and sorted(map(tuple, back.collect())) == [(0, 1, 5), (1, 0, 7)]
