import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.operators import moment_store as S
from cellarium.operators.cuboid import cells, dense_array
from cellarium.operators.schema import CubeSchema, Tree, presence, required, types_of
from cellarium.operators.user import UserCube, printed

ROWS = [
    {"name": "a", "Region": "India", "spicy": 1, "rating": 4},
    {"name": "b", "Region": "Italy", "spicy": 0, "rating": 7},
    {"name": "c", "Region": "Italy", "rating": 8},
    {"name": "d", "rating": 4, "spicy": 1},
    {"name": "e", "Region": "Europe", "rating": 12, "spicy": -3},
    {"name": "f", "Region": "India", "rating": 5, "spicy": 1},
]


@pytest.fixture(scope="module")
def user(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("user")
    (d / "rows.json").write_text(json.dumps(ROWS))
    return UserCube.from_json(spark, str(d / "rows.json"), "rating", str(d / "cube"), log_n=4, min_d=2, max_d=4)


def test_schema(user):
    assert user.schema.columns == {"Region?": 1, "Region": 2, "name": 3, "spicy?": 1, "spicy": 2, "-spicy": 1}


def test_forms(spark, user):
    got = {(r["Region?"], r["Region"]): r["measure"] for r in user.query({"Region?": 1, "Region": 2}).collect()}
    assert got == {("1", "India"): 9, ("1", "Italy"): 15, ("1", "Europe"): 12, ("0", "Europe"): 4}
    rows, top, x = user.query({"Region": 2}, {"Region?": 1}, form="array")
    assert top == ["Region?=0", "Region?=1"] and x.sum() == 40 and len(rows) == 3
    matrix = user.query({"Region": 2}, {"-spicy": 1}, form="matrix")
    assert {r["Region"]: r["-spicy=1"] for r in matrix.collect()} == {"Europe": 12, "India": None, "Italy": None}
    assert user.query({"Region": 2}, form="bits").columns == ["b1", "b2", "measure"]
    assert user.query_all().count() == 6
    assert "India" in printed(user.query({"Region": 2}))
    with pytest.raises(ValueError):
        user.query({"Region": 2}, form="x")


def test_moment_method(user):
    exact = {r["Region"]: r["measure"] for r in user.query({"Region": 2}, zero=True).collect()}
    close = {r["Region"]: r["measure"] for r in user.query({"Region": 2}, method="moment", zero=True, primary=user.cube.primary_moments()).collect()}
    assert all(np.isclose(close[k], v, atol=3) for k, v in exact.items())


def test_query_dimension(user):
    got = {r["x"]: r["total"] for r in user.query_dimension("Region", "spicy").collect()}
    assert got == {"India": 1, "Italy": 0, "Europe": 4}


def test_save_and_load(spark, user):
    again = UserCube.load(spark, user.cube.path)
    assert again.schema.columns == user.schema.columns and again.query_all().count() == 6


def test_extended(spark, user):
    more = spark.createDataFrame([("z", "Africa", 9)], "name string, Region string, spicy long")
    wide = user.schema.extended(more)
    assert wide.columns["spicy"] == 4
    old = {r["value"]: r["code"] for r in user.schema.dictionaries["Region"].collect()}
    new = {r["value"]: r["code"] for r in wide.dictionaries["Region"].collect()}
    assert new == old | {"Africa": 3}


def test_trees():
    day = Tree("date", parts=(Tree("month", (0, 1)), Tree("week", (2, 3, 4))), cross=False)
    t = Tree("all", parts=(day, Tree("x", (5,))))
    assert t.prefix_counts(2) == [1, 3, 4]
    assert len(t.queries_upto(2)) == 8 and (1, 5) in t.queries() and (0, 5) not in t.queries()


def test_drift_tables(spark):
    df = spark.createDataFrame([(0, "1", None), (1, "x", "2020-01-01")], "Time int, a string, b string")
    assert [tuple(r) for r in presence(df, "Time").orderBy("Time").collect()] == [(0, 1, 0), (1, 1, 1)]
    assert [tuple(r) for r in types_of(df, "Time").orderBy("Time").collect()] == [(0, "Int", "Any"), (1, "String", "Date")]
    assert required([{"a": 1, "b": 2}, {"a": 3}]) == ["a"]


def test_moment_store(spark, user, tmp_path):
    c = user.cube
    bits = list(range(6))
    store = S.build(c, bits, 6)
    S.save(store, str(tmp_path / "m"))
    q = [0, 2, 5]
    got = S.solve(S.load(spark, str(tmp_path / "m")), q, 6)
    assert np.allclose(got, dense_array(cells(c.base, [c.bit_column(b) for b in q]), 3))
    assert S.relevant(store, 0b100101).count() == store.where(F.col("mask").bitwiseAND(F.lit(~0b100101)) == 0).count()


def test_infer_without_measure(spark):
    u = UserCube.from_rows(spark.createDataFrame([("x", 1), ("x", 2)], "a string, n int"))
    assert u.query({"a": 1}).first()["measure"] == 2
    assert CubeSchema.infer(spark.createDataFrame([], "a string, n int")).columns == {"a": 1, "n": 1}


def test_criteria_on_any_column(user):
    """Rows are filtered by columns that the answer doesn't have; with any_of one criterion is enough."""
    got = {r["Region"]: r["measure"] for r in user.query({"Region": 2}, where={"spicy": ["1"], "Region": ["India"]}).collect()}
    assert got == {"India": 9}
    got = {r["Region"]: r["measure"] for r in user.query({"Region": 2}, where={"name": ["a", "c"]}).collect()}
    assert got == {"India": 4, "Italy": 8}
    got = {r["Region"]: r["measure"] for r in user.query({"Region": 2}, where={"name": ["a"], "Region": ["Italy"]}, any_of=True).collect()}
    assert got == {"India": 4, "Italy": 15}
    with pytest.raises(ValueError):
        user.query({"Region": 2}, where={"name": ["a"]}, method="moment")


def test_signs_and_trends(spark):
    cube = UserCube.from_rows(spark.createDataFrame([("x", t, v) for t, v in enumerate([1, 5, 2, 9, 3, 8])] + [("y", t, t + 1) for t in range(6)], "s string, t int, v long"), "v")
    got = {r["series"]: (r["breaks"], r["monotone"], r["double_peak"]) for r in cube.trends("s", "t").collect()}
    assert got == {"x": (4, False, True), "y": (0, True, False)}
    assert {r["series"]: r["breaks"] for r in cube.trends("s", "t", where={"t": ["<3"]}).collect()} == {"x": 1, "y": 0}
    signed = UserCube.from_rows(spark.createDataFrame([(-3, 1), (2, 1)], "n int, v long"), "v")
    assert sorted(r["n"] for r in signed.query({"n": 2, "-n": 1}).collect()) == ["-3", "2"]


def test_bounded_answers(user, monkeypatch):
    from cellarium.operators import cube as C
    from cellarium.operators import user as U

    monkeypatch.setattr(U, "ARRAY_ROWS", 1)
    with pytest.raises(ValueError):
        user.query({"Region": 2}, {"spicy?": 1}, form="array")
    monkeypatch.setattr(C, "PIVOT_BITS", 1)
    with pytest.raises(ValueError):
        user.cube.query({"Region": 2}, {"name": 3})
