from pyspark.sql import functions as F

from cellarium.operators import analytics as A


def test_windows_without_partitions(spark, monkeypatch):
    """Many ranges give what one window over everything gives."""
    monkeypatch.setattr(A, "RANK_ROWS", 20)
    rows = [(i * 7 % 200, i) for i in range(150)] + [(3, 5), (3, 6), (None, 9), (None, 4)]
    df = spark.createDataFrame(rows, "d int, measure long")
    got = sorted(map(tuple, A.window_values(df, "d", 5).collect()), key=str)
    want = sorted(((d, m, sum(x for e, x in rows if (e is None if d is None else e is not None and d <= e <= d + 5))) for d, m in rows), key=str)
    assert got == want
    whole = sorted(x for x in rows if x[0] is not None and x != (3, 5) and x != (3, 6))
    got = sorted(map(tuple, A.window_rows(spark.createDataFrame(whole, "d int, measure long"), "d", 4).collect()))
    assert got == [(d, m, sum(x for _, x in whole[i : i + 4])) for i, (d, m) in enumerate(whole)]
    assert A.window_values(df.limit(0), "d", 5).count() == 0


def test_changes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "RANK_ROWS", 7)
    rows = [(i, 1 if i // 9 % 2 else None, 1 if i < 50 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "t int, a int, b int")
    got = sorted(map(tuple, A.null_changes(df, "t", ["a", "b"]).collect()))
    want = []
    for c, k in (("a", 1), ("b", 2)):
        was = False
        for r in rows:
            if (r[k] is not None) != was:
                was = not was
                want.append((c, r[0], "add" if was else "remove"))
    assert got == sorted(want)
    assert A.null_changes(df.limit(0), "t", ["a"]).count() == 0


def test_criteria_on_texts(spark):
    df = spark.createDataFrame([("apple",), ("pear",), ("12",), (None,)], "x string")
    pick = lambda t: [r["x"] for r in df.where(A.criterion(F.col("x"), [t])).collect()]
    assert pick("<b") == ["apple", "12"] and pick(">=10") == ["12"] and pick(">banana") == ["pear"]
