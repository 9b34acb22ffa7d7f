from types import SimpleNamespace

from pyspark.sql import functions as F

from cellarium.llm import common as C


def test_words_and_windows():
    assert C.ascii_words("A B\tc\x0bD É") == ["a b".encode(), b"c", b"d", "É".encode()]
    assert C.ascii_words(None) == []
    h = C.WordHash().of([b"a", b"b", b"a", b"b", b"a"])
    assert len(C.windows(h, 2)) == 4 and len(set(C.windows(h, 2).tolist())) == 2
    assert len(C.shingles(h, 9)) == 1 and len(C.shingles(h[:0], 5)) == 0


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_LEAST", 5)
    left = C.written(spark.range(400).select("id", F.when(F.col("id") < 300, 1).when(F.col("id") < 310, None).otherwise(F.col("id")).alias("k")))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (320, "c"), (999, "d")], "k int, x string")
    for how in ("inner", "left", "left_anti"):
        got = sorted(map(tuple, C.skew_join(left, right, ["k"], ["id"], how).select("id", *(["x"] if how != "left_anti" else [])).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, ["k"], how).select("id", *(["x"] if how != "left_anti" else [])).collect()), key=str)
    assert C.skew_join(left.limit(0), right, ["k"], ["id"]).count() == 0


def test_written_ends_lineage(spark):
    df = C.written(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_files_follow_the_texts(spark):
    """A few texts in many partitions make few files, and a task makes no more than its share of many."""
    few, rows = 2 * spark.sparkContext.defaultParallelism, spark.range(0, 1000, 1, 100).withColumn("text", F.lit("some text"))
    for size, most in ((9000, few), (C.FILE_BYTES * 90, max(few, 90))):
        got = C.written(rows, text_bytes=size)
        assert len(got.inputFiles()) <= min(most, 100) and got.count() == 1000
    assert len(C.written(rows).inputFiles()) == 100


def test_a_pass_releases_its_memory(monkeypatch):
    """At its end, whole or broken off: workers live on."""
    ends = []
    monkeypatch.setattr(C, "ship", lambda spark: None)
    monkeypatch.setattr(C, "release", lambda: ends.append(1))
    run = C.arrow_pass(SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(set=lambda *a: None)), mapInArrow=lambda f, schema: f), lambda b: (x + 1 for x in b), "x long")
    assert list(run(iter([1, 2]))) == [2, 3] and ends == [1]
    broken = run(iter([1, 2]))
    next(broken)
    broken.close()
    assert ends == [1, 1]
