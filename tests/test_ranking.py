from pyspark.sql import functions as F

from cellarium.ranking import ranked


def test_ranks_are_global(spark):
    df = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(40)).alias("a"), F.col("id").alias("b"))
    got = [(r["at"], r["a"], r["b"]) for r in ranked(df, ["a", "b"], "at", rows=200).orderBy("at").collect()]
    want = sorted((r["a"], r["b"]) for r in df.collect())
    assert got == [(i, *w) for i, w in enumerate(want)]


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(None, None)], "a int, b string")
    got = [(r["at"], r["a"]) for r in ranked(df, ["a"], "at", rows=7).orderBy("at").collect()]
    assert [x for x, _ in got] == list(range(51)) and got[0] == (0, None)
    assert ranked(df.limit(0), ["a"], "at").count() == 0
