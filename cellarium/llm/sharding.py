"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard by the hash of its id. In each round a linked
document wants to be where most of its group is; an 8 x 8 table of wishes, cut to the shards' free capacity, says how
many may go from one shard to another, and buckets of group hashes decide which, so that a group moves together. When
no move is left, the few groups that are too large to move as one, and then those that lie in several shards still, fill
the shards' gaps one after another, so that only those at the end of a gap are cut; rows without links (they cut nothing
wherever they lie) fill the rest, to counts that are at most one apart: law ``rows``.

Only counts by group and shard, by shards and bucket, or by bucket travel between stages: a group of any size is
pre-aggregated, joins deal the rows of large groups, and ranks come from sampled ranges of (group, row), so a group's rows
lie in as many tasks as their number asks for.

Defined results: a null text has size 1, crc32 0 and no links; empty texts are equal texts; rows that repeat are rows of
their own; a null id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.ranking import ranked

from .common import forget, skew_join, table, written

SHARDS = 8
#: Rounds at most; propagation ends before when no bucket can move.
ROUNDS = 20
BUCKETS = 256


def allowed_moves(want: list[list[int]], room: list[int]) -> list[list[int]]:
    """The part of the wishes that leaves no shard above its capacity. room: free places, negative if it holds too many."""
    k = len(room)
    flow = [row[:] for row in want]
    for _ in range(50):
        changed = False
        for j in range(k):
            most = max(0, room[j] + sum(flow[j]))
            inflow = sum(flow[i][j] for i in range(k))
            if inflow > most:
                changed = True
                had = [flow[i][j] for i in range(k)]
                left = most
                for i in range(k):
                    flow[i][j] = had[i] * most // inflow
                    left -= flow[i][j]
                for i in range(k):  # what rounding left over
                    more = min(left, had[i] - flow[i][j])
                    flow[i][j] += more
                    left -= more
        if not changed:
            return flow
    return [[0] * k for _ in range(k)]


def _chosen_buckets(wishes: list, room: list[int], shards: int) -> list[tuple[int, int, int]]:
    """(from, to, bucket) that move whole: each pair's buckets in turn as long as they fit the allowed flow."""
    want = [[0] * shards for _ in range(shards)]
    for r in wishes:
        want[r["shard"]][r["best"]] += r["c"]
    flow = allowed_moves(want, room)
    out = []
    for r in sorted(wishes, key=lambda r: (r["shard"], r["best"], r["bucket"])):
        if r["c"] <= flow[r["shard"]][r["best"]]:
            flow[r["shard"]][r["best"]] -= r["c"]
            out.append((r["shard"], r["best"], r["bucket"]))
    # only whole buckets went, so shards that counted on them leaving are checked again
    size = {(r["shard"], r["best"], r["bucket"]): r["c"] for r in wishes}
    while True:
        net = room[:]
        for i, j, b in out:
            net[i] += size[i, j, b]
            net[j] -= size[i, j, b]
        over = [j for j in range(shards) if net[j] < min(0, room[j])]
        if not over:
            return out
        j = over[0]
        drop = next(x for x in reversed(out) if x[1] == j)
        out.remove(drop)


def _moved(rows: DataFrame, chosen: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of the chosen buckets go to the shard they want. At most shards**2 * BUCKETS keys, as one literal."""
    going = F.array(*[F.lit((i * 1024 + j) * 1024 + b) for i, j, b in chosen]) if chosen else F.array().cast("array<int>")
    key = (F.col("shard") * 1024 + F.col("best")) * 1024 + F.col("bucket")
    return rows.withColumn("shard", F.when(F.array_contains(going, key.cast("int")), F.col("best")).otherwise(F.col("shard")))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has none), group_rows."""
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("g1"), F.when(text.isNotNull(), F.xxhash64(text, F.lit(1))).alias("g2"),
        F.xxhash64(F.col(id_col), F.lit(2)).alias("h"),
    )
    base = written(base)
    n = base.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = base.where("g1 is not null").groupBy("g1", "g2", "size").agg(F.count("*").alias("m")).where("m > 1")
    # at most 4 * shards groups are too large to move as one: they fill gaps one after another at the end
    large = max(1, n // (4 * shards))
    hot = groups.where(F.col("m") > large).orderBy(F.desc("m"), "g1", "g2").limit(4 * shards).collect()
    bucket = F.pmod(F.xxhash64("g1", "g2", F.lit(3)), F.lit(BUCKETS)).cast("int")
    small = groups.where(F.col("m") <= large)
    linked = skew_join(base.where("g1 is not null"), small, ["g1", "g2", "size"], ["h"]).select("doc_id", "size", "text_crc32", "g1", "g2", "h", "m", bucket.alias("bucket"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    linked = written(linked, n)

    for _ in range(rounds):
        held = {r["shard"]: r["c"] for r in linked.groupBy("shard").agg(F.count("*").alias("c")).collect()}  # a row a shard
        room = [quota[s] - held.get(s, 0) for s in range(shards)]
        counts = linked.groupBy("g1", "g2", "size", "shard").agg(F.count("*").alias("c"))
        most = F.max(F.struct("c", F.xxhash64("g1", "shard").alias("t"), "shard")).alias("b")  # ties fall evenly on the shards
        best = counts.groupBy("g1", "g2", "size").agg(most).select("g1", "g2", "size", F.col("b.shard").alias("best"))
        rows = skew_join(linked, best, ["g1", "g2", "size"], ["h"])
        wishes = rows.where("shard <> best").groupBy("shard", "best", "bucket").agg(F.count("*").alias("c")).collect()  # shards**2 * BUCKETS rows at most
        chosen = _chosen_buckets(wishes, room, shards)
        if not chosen:
            break
        old, linked = linked, written(_moved(rows, chosen).drop("best"), n)
        forget(old)

    keys = ["g1", "g2", "size"]
    apart = linked.groupBy(*keys).agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a < b").select(*keys)
    gathered = written(skew_join(linked, apart, keys, ["h"], "left_anti"), n)
    split = skew_join(linked, apart, keys, ["h"])
    linked = gathered
    held = {r["shard"]: r["c"] for r in linked.groupBy("shard").agg(F.count("*").alias("c")).collect()}  # a row a shard
    starts = [sum(held.get(t, 0) for t in range(s)) for s in range(shards)]
    rows = linked.select("doc_id", "size", "text_crc32", "m", "h", "shard", F.xxhash64("g1", "g2").alias("o"))
    placed = ranked(rows, ["shard", "o", "h"], "place")  # shard by shard, group by group
    placed = placed.withColumn("rank", F.col("place") - F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1))
    quotas = F.array(*[F.lit(q).cast("long") for q in quota])
    kept = placed.where(F.col("rank") < F.element_at(quotas, F.col("shard") + 1))
    filled = [min(held.get(s, 0), quota[s]) for s in range(shards)]
    number = F.lit(len(hot) + 1)  # after the large groups and the split ones
    for i, r in enumerate(hot):
        number = F.when((F.col("g1") == r["g1"]) & (F.col("g2") == r["g2"]) & (F.col("size") == r["size"]), F.lit(i)).otherwise(number)
    rows_of = F.element_at(F.array(*[F.lit(r["m"]) for r in hot], *[F.lit(1).cast("long")] * 2), number + 1)
    alone = base.where("g1 is null").unionByName(skew_join(base.where("g1 is not null"), small.select("g1", "g2", "size"), ["g1", "g2", "size"], ["h"], "left_anti"))
    columns = ["doc_id", "size", "text_crc32", "m", "h", "o", "hot"]
    free = alone.select("doc_id", "size", "text_crc32", rows_of.alias("m"), "h", F.lit(0).cast("long").alias("o"), number.alias("hot"))
    rest_of = split.withColumns({"o": F.xxhash64("g1", "g2"), "hot": F.lit(len(hot))}).select(*columns)
    over = placed.where(F.col("rank") >= F.element_at(quotas, F.col("shard") + 1)).withColumn("hot", F.lit(len(hot))).select(*columns)
    pool = ranked(written(free.unionAll(rest_of).unionAll(over), n), ["hot", "o", "h"], "at")  # one group after another, then the rest
    start, shard, slot = 0, F.lit(shards - 1), F.lit(0).cast("long")
    for s in range(shards):  # the pool's ranks fill the shards' gaps in turn
        gap = quota[s] - filled[s]
        here = (F.col("at") >= start) & (F.col("at") < start + gap)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("at") - start + filled[s]).otherwise(slot)
        start += gap
    out = [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.lit("rows").alias("law")]
    rest = [F.lit(None).cast("int").alias("grown_shard"), F.col("m").alias("group_rows")]
    a = kept.select(*out, F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"), *rest)
    b = pool.select(*out, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), *rest)
    return a.unionAll(b)


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op4_balanced_shards": op4_balanced_shards}
ORACLE: dict[str, str] = {}
