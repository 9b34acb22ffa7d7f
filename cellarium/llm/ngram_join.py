"""N-gram Jaccard join: components of documents whose word-shingle sets have a Jaccard similarity of 0.8 or more.

1. Equal sets are one class, held by its least doc_id.
2. Two similar sets share one of the first n - ceil(0.8 n) + 1 shingles of any common order. Rare shingles come first
   (a bounded list of the most frequent ones ranks last), so a shingle's documents are few unless they are alike.
3. The documents of a shingle are ranked by size and cut into blocks of bounded rows; a tile is two blocks, and only blocks
   whose sizes come within 0.8 of each other, and rows whose sizes do, meet.
   Each set has a parity bitmap as long as its size band asks: bits that differ bound the symmetric difference from
   below, hence the overlap from above, before texts are fetched and their sorted hash arrays intersected.
4. First each document meets one centre of its shingle. What these links have joined needs no further comparison, so
   a large group of near copies costs one comparison each; all pairs that still lie in different components follow.
5. All links lie inside components. So the classes of each are cut into blocks by size band, and tiles of two blocks
   intersect all their sets and give each class its number of links; no pair becomes a row.

Every stage is a shuffle by shingle, by document or by tile; pairs travel with their texts row by row, so no group is ever held
by one task. The order of shingles decides cost only: no link depends on it.

Defined results: a text without words (null, empty) has size 0 and is linked with nothing; a text of fewer words than a
shingle is one shingle; rows that repeat a doc_id are one document (with different texts they count as linked, and each
set's links count); a row without doc_id gets a null component and no number of links; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, ascii_words, batch_of, forget, shingles, skew_join, table, word_hash, written
from .graph import components

SHINGLE_WORDS = 5
#: Jaccard similarity of 80 / 100 at least.
NUM, DEN = 80, 100
#: Frequent shingles that rank last; each task proposes FREQUENT_LOCAL. Bounds of a broadcast list that only orders.
FREQUENT, FREQUENT_LOCAL, FREQUENT_FOLD = 100_000, 10_000, 2_000_000
#: Rows of one shingle in a block; two blocks meet in a tile.
TILE_ROWS = 512
#: A tile row names its document's other open shingles up to this many, so that a pair is named once; beyond, pairs repeat.
TILE_KEYS = 64
#: Shingles and classes of one component in a block of the count of links.
LINK_SHINGLES, LINK_ROWS = 1_000_000, 2048
#: Cells that the count of a tile's links works on at once, beside one matrix of all its pairs.
LINK_CELLS = 500_000
#: About the bytes of a word and its space; decides the number of files only.
WORD_BYTES = 8
#: Different centres that the shingles of a document can have.
CENTRES = 4


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """Exact: both arrays are sorted and distinct."""
    if not len(a) or not len(b) or min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return den * both >= num * (len(a) + len(b) - both)


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of as many bits as the next power of two of the set's size, 64 at least."""
    bits = 1 << max(6, (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Frequent:
    """The most frequent shingles so far, in bounded memory."""

    def __init__(self):
        self.keys, self.counts, self.held, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.n += len(s)
        if self.n >= FREQUENT_FOLD:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        k, c = np.unique(np.concatenate(self.held), return_counts=True)
        k, c = k[c > 1], c[c > 1]
        keys, inverse = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([self.counts, c])).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[: 4 * FREQUENT_LOCAL]
        self.keys, self.counts, self.held, self.n = keys[top], counts[top], [], 0

    def top(self, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        k, c = self.keys[:FREQUENT_LOCAL], self.counts[:FREQUENT_LOCAL]
        return k[c >= least], c[c >= least]


_FACTS = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.binary())])


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: a document's id, set size, set digest and bitmap. kind 1: a frequent shingle and its count."""

    def run(batches):
        words, frequent = word_hash(), _Frequent()
        for b in batches:
            n, h, bits = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(words.of(ascii_words(text)), size)
                frequent.add(s)
                n.append(len(s))
                h.append(xxhash.xxh128_digest(s.tobytes()))
                bits.append(signature(s))
            h = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield batch_of(_FACTS, kind=np.zeros(len(n), np.int8), id=b.column(0), n=n, h1=h[:, 0], h2=h[:, 1], bits=bits)
        k, c = frequent.top()
        none = np.zeros(len(k), np.int64)
        yield batch_of(_FACTS, kind=np.ones(len(k), np.int8), id=k.view(np.int64), n=c, h1=none, h2=none, bits=[None] * len(k))

    return arrow_pass(docs, run, "kind byte, id long, n long, h1 long, h2 long, bits binary")


_PREFIX = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])


def _prefixes(docs: DataFrame, size: int, num: int, den: int, keys: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(shingle, document, set size) for each document's first shingles, rare ones first; a task names a class once."""

    def run(batches):
        words, seen = word_hash(), set()
        for b in batches:
            key, ids, ns = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(words.of(ascii_words(text)), size)
                if i is None or not len(s) or (digest := xxhash.xxh128_digest(s.tobytes())) in seen:
                    continue
                seen.add(digest)
                p = prefix_length(len(s), num, den)
                if len(keys):
                    at = np.searchsorted(keys, s)
                    at[at == len(keys)] = 0
                    rank = np.where(keys[at] == s, ranks[at], 0)
                    s = s[np.argsort(rank, kind="stable")] if rank.any() else s
                key.append(s[:p])
                ids.append(np.full(p, i, np.int64))
                ns.append(np.full(p, len(s), np.int32))
            if key:
                yield batch_of(_PREFIX, key=np.concatenate(key).view(np.int64), id=np.concatenate(ids), n=np.concatenate(ns))

    return arrow_pass(docs, run, "key long, id long, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows whose shingle another document has too. Sorted runs are read as a stream; one row is held."""

    def run(batches):
        carry, flag = None, False
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c) for c in b.columns]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols, strict=True)]
            same = cols[0][1:] == cols[0][:-1]
            out = np.zeros(len(cols[0]), bool)
            out[:-1] |= same
            out[1:] |= same
            out[0] |= flag
            carry, flag = [c[-1:] for c in cols], bool(out[-1])
            out[-1] = False
            if out.any():
                yield batch_of(_PREFIX, **dict(zip(_PREFIX.names, (c[out] for c in cols), strict=True)))
        if flag:
            yield batch_of(_PREFIX, **dict(zip(_PREFIX.names, carry, strict=True)))

    return arrow_pass(prefixes.repartition("key").sortWithinPartitions("key", "n"), run, "key long, id long, n int")


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar. Both texts come by joins; every row stands alone."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    rows = skew_join(pairs, right, ["v"], ["u"]).join(left, "u").select("u", "v", "tu", "tv")  # v may be the centre of very many

    def run(batches):
        words = word_hash()
        held = lru_cache(maxsize=128)(lambda text: shingles(words.of(ascii_words(text)), size))
        for b in batches:
            good = [similar(held(x), held(y), num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return arrow_pass(rows, run, "u long, v long").distinct()


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    """The bitmap that ``width`` words would have given."""
    while len(x) > width:
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return x


def possible(a: bytes, b: bytes, na: int, nb: int, num: int = NUM, den: int = DEN) -> bool:
    """Whether the bits that differ leave room for similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    width = min(len(x), len(y))
    differ = int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())
    return (num + den) * ((na + nb - differ) // 2) >= num * (na + nb)


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that their bitmaps leave possible."""
    left = nodes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu"))
    right = nodes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv"))
    rows = skew_join(pairs, right, ["v"], ["u"]).join(left, "u").select("u", "v", "bu", "bv", "nu", "nv")

    def run(batches):
        for b in batches:
            good = [possible(*r, num, den) for r in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return arrow_pass(rows, run, "u long, v long")


def tile_pairs(sizes, comps, blocks, bits, num: int = NUM, den: int = DEN):
    """Pairs (as row numbers) of a tile, sorted by size, that may be similar: other component, size within bounds, and enough overlap left
    by the bits that differ. In a tile of two blocks only rows of different blocks meet."""
    words = [np.frombuffer(x, np.uint64) for x in bits]
    n = len(sizes)
    mixed = bool((blocks != blocks[0]).any())
    stacks: dict[tuple[int, int], np.ndarray] = {}

    def folded(lo: int, hi: int, width: int) -> np.ndarray:
        return np.array([_fold(words[j], width) for j in range(lo, hi)], np.uint64).reshape(hi - lo, width)

    last = np.searchsorted(sizes, sizes * den // num, side="right")
    if n > 16:  # the stack of each width once, over all rows that are as wide at least
        widths = np.array([len(x) for x in words])
        for w in np.unique(widths):
            lo = int(np.searchsorted(widths, w, side="left"))
            hi = int(last[np.searchsorted(widths, w, side="right") - 1])
            stacks[int(w), lo] = folded(lo, hi, int(w))
        start = {w: lo for w, lo in stacks}
    for i in range(n - 1):
        hi = int(last[i])
        if hi <= i + 1:
            continue
        width = len(words[i])
        other = stacks[width, start[width]][i + 1 - start[width] : hi - start[width]] if stacks else folded(i + 1, hi, width)
        differ = np.bitwise_count(other ^ words[i]).sum(axis=1, dtype=np.int64)
        total = sizes[i + 1 : hi] + sizes[i]
        good = (comps[i + 1 : hi] != comps[i]) & ((num + den) * ((total - differ) // 2) >= num * total)
        if mixed:
            good &= blocks[i + 1 : hi] != blocks[i]
        for j in np.flatnonzero(good):
            yield i, i + 1 + int(j)


def _tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: (key, bi, bj, n, id, comp, block, bits, keys) sorted by key and blocks, then size, within each partition.

    A pair that shares several shingles is named by the least of them only, where both name theirs.
    """

    def run(batches):
        def pairs(group):
            key, ids, keys = group.column("key")[0].as_py(), group.column("id").to_numpy(), group.column("keys")
            held: dict[int, np.ndarray] = {}

            def of(i):
                if i not in held:
                    held[i] = keys[i].values.to_numpy() if keys[i].is_valid else None
                return held[i]

            for i, j in tile_pairs(group.column("n").to_numpy().astype(np.int64), group.column("comp").to_numpy(), group.column("block").to_numpy(), group.column("bits").to_pylist(), num, den):
                if of(i) is None or of(j) is None or np.intersect1d(of(i), of(j), assume_unique=True)[0] == key:
                    yield int(ids[i]), int(ids[j])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            k, bi, bj = (rest.column(c).to_numpy() for c in ("key", "bi", "bj"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            if not len(cut):
                continue
            whole = rest.slice(0, int(cut[-1])).combine_chunks()
            edges = np.concatenate([[0], cut])
            out = [p for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi - lo > 1 for p in pairs(whole.slice(int(lo), int(hi - lo)))]
            rest = rest.slice(int(cut[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=_LINK)
        if rest is not None and rest.num_rows > 1 and (out := list(pairs(rest.combine_chunks()))):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=_LINK)

    return arrow_pass(rows, run, "u long, v long")


def links_of(ids: list[int], blocks: list[int], sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> np.ndarray:
    """How many sets of other documents each of a tile's sets is similar to. In a tile of two blocks only rows of different
    blocks meet. Exact."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    block, doc = np.array(blocks), np.array(ids)
    out = np.zeros(n, np.int64)
    mixed = len(set(blocks)) > 1
    if n <= 16:
        for i in range(n):
            for j in range(i):
                if doc[i] != doc[j] and not (mixed and block[i] == block[j]) and similar(sets[i], sets[j], num, den):
                    out[i] += 1
                    out[j] += 1
        return out
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    both = np.zeros((n, n), np.float32)  # whole numbers below 2**24
    frequent = counts * 16 > n
    at = np.flatnonzero(frequent)
    place = np.full(len(counts), -1)
    place[at] = np.arange(len(at))
    order = np.argsort(column, kind="stable")
    edges = np.concatenate([[0], np.cumsum(counts)])
    strip, wide = max(1, LINK_CELLS // n), max(64, 8 * LINK_CELLS // n)
    for lo in range(0, len(at), wide):
        here = (place[column] >= lo) & (place[column] < lo + wide)
        x = np.zeros((n, min(wide, len(at) - lo)), np.float32)
        x[row[here], place[column[here]] - lo] = 1
        for i in range(0, n, strip):
            both[i : i + strip] += x[i : i + strip] @ x.T
    rare = np.flatnonzero(~frequent & (counts > 1))
    for c in np.unique(counts[rare]):  # the columns of c rows at once, in parts
        some = rare[counts[rare] == c]
        for lo in range(0, len(some), part := max(1, 1_000_000 // int(c * c))):
            rows = row[order[edges[some[lo : lo + part], None] + np.arange(c)]]
            pairs = (rows[:, :, None] * n + rows[:, None, :]).ravel()
            where, often = np.unique(pairs, return_counts=True)
            both.ravel()[where] += often
    for i in range(0, n, strip):
        s = slice(i, i + strip)
        shared = both[s].astype(np.int64)
        good = (den * shared >= num * (sizes[s, None] + sizes[None, :] - shared)) & (doc[s, None] != doc[None, :])
        if mixed:
            good &= block[s, None] != block[None, :]
        out[s] = good.sum(axis=1)
    return out


def _tiled(rows: DataFrame, group: str, parts: Column, by_rows: int) -> DataFrame:
    """Adds ``tile`` (two block names, bi and bj) and ``block`` (the row's own), a row for each tile that it takes part in.

    rows, a written table: ``group``, id, band. A group is cut by band, and a band into ``parts`` (an aggregate) by the
    hash of the id; blocks of equal and of adjacent bands meet. A group of one part is one tile, of block 0.
    """
    name = lambda band, i: (band.cast("long") * (1 << 32) + i.cast("long") + 1).cast("long")
    whole = rows.groupBy(group).agg(parts.alias("all")).where("all > 1").select(group)
    own = written(rows.join(whole, group).groupBy(group, "band").agg(parts.alias("own")), by_rows)
    beside = lambda by, c: own.select(group, (F.col("band") - by).cast("int").alias("band"), F.col("own").alias(c))
    sides = own.join(beside(1, "up"), [group, "band"], "left").join(beside(-1, "down"), [group, "band"], "left")
    rows = skew_join(rows, sides, [group, "band"], ["id"], "left")
    i = F.pmod(F.xxhash64("id", F.lit(9)), F.coalesce("own", F.lit(1))).cast("long")
    rows = rows.withColumn("block", F.when(F.col("own").isNull(), F.lit(0).cast("long")).otherwise(name(F.col("band"), i)))
    block = F.col("block")

    def tiles(c: str, by: int) -> Column:
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1), lambda j: name(F.col("band") + by, j))
        made = F.transform(others, lambda o: F.struct(F.least(block, o).alias("bi"), F.greatest(block, o).alias("bj")))
        return F.when(F.col(c).isNull(), F.array().cast("array<struct<bi:bigint,bj:bigint>>")).otherwise(made)

    alone = F.array(F.struct(block.alias("bi"), block.alias("bj")))
    every = F.when(F.col("own").isNull(), alone).otherwise(F.concat(tiles("own", 0), tiles("up", 1), tiles("down", -1)))
    return rows.withColumn("tile", F.explode(every)).drop("own", "up", "down")


def _band(n: Column, num: int, den: int) -> Column:
    """Wider than the bound: only sets of equal and of adjacent bands can be similar."""
    return F.floor(F.log(n.cast("double")) / F.lit(_band_width(num, den))).cast("int")


def _band_width(num: int, den: int) -> float:
    return float(np.log(1.01 * den / num))


_COUNT = pa.schema([("id", pa.int64()), ("links", pa.int64())])


def _links(roots: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int, n_rows: int) -> DataFrame:
    """(id, links): the number of other classes that each class is similar to; classes without links are left out."""
    comps = roots.select(F.col("node").alias("id"), F.col("root").alias("comp")).unionAll(roots.select(F.col("root").alias("id"), F.col("root").alias("comp"))).distinct()
    # a document of several sets stands in all bands between
    spans = nodes.groupBy("id").agg(_band(F.min("n"), num, den).alias("lo"), _band(F.max("n"), num, den).alias("hi"), F.sum("n").alias("n"))
    bands = written(spans.join(comps, "id").select("id", "comp", "n", F.explode(F.sequence("lo", "hi")).alias("band")), n_rows)
    parts = F.greatest(F.ceil(F.sum("n") / LINK_SHINGLES), F.ceil(F.count("*") / LINK_ROWS)).cast("int")
    rows = _tiled(bands, "comp", parts, 0)
    rows = rows.select("id", "comp", "tile.bi", "tile.bj", "block", F.when(F.col("block") == 0, F.lit(-1)).otherwise(F.col("band")).alias("home")).distinct()
    rows = rows.join(texts, "id").select("comp", "bi", "bj", "id", "block", "home", "text")
    keys = ["comp", "bi", "bj"]
    width = _band_width(num, den)

    def run(batches):
        words = word_hash()
        key, ids, blocks, sets, seen = None, [], [], [], set()

        def counted():
            _, bi, bj = key
            meet = len(ids) > 1 and (bi == bj or len(set(blocks)) > 1)  # the other block may have no rows
            got = links_of(ids, blocks, sets, num, den) if meet else np.zeros(len(ids), np.int64)
            some = np.flatnonzero(got)
            return batch_of(_COUNT, id=np.array(ids, np.int64)[some], links=got[some])

        for b in batches:
            for *k, i, block, home, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key is not None:
                        yield counted()
                    key, ids, blocks, sets, seen = k, [], [], [], set()
                s = shingles(words.of(ascii_words(text)), size)
                if not len(s) or home >= 0 and int(np.floor(np.log(float(len(s))) / width)) != home:
                    continue
                if (known := (i, s.tobytes() if len(s) < 16 else xxhash.xxh128_digest(s.tobytes()))) in seen:
                    continue
                seen.add(known)
                ids.append(i)
                blocks.append(block)
                sets.append(s)
        if key is not None:
            yield counted()

    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return arrow_pass(rows, run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (least doc_id with an equal set), component_id and
    n_links (the number of other classes whose sets are similar to the row's class; exact)."""
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    facts = written(_facts(docs, size))
    common = facts.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).where("c >= 8").orderBy(F.desc("c"), "id").limit(FREQUENT).toArrow()
    keys, counts = common.column("id").to_numpy().view(np.uint64), common.column("c").to_numpy()
    order = np.argsort(keys)
    keys, ranks = keys[order], counts[order].astype(np.int64)

    sets = facts.where("kind = 0").drop("kind")
    worded = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = sets.where(worded).groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1
    total = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 0, prefix)), F.lit(0)).cast("long").alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_rows, most = total["n"], total["p"]
    sets = skew_join(sets, classes.where("m > 1").drop("m"), ["h1", "h2", "n"], ["id"], "left")
    sets = written(sets.select("id", "n", F.when(worded, F.coalesce("rep", "id")).alias("rep"), "bits"), n_rows)
    forget(facts)
    nodes = sets.where("id = rep").select("id", "n", "bits").distinct()

    shared = written(_shared(_prefixes(docs, size, num, den, keys, ranks)), most)
    tiles = shared.join(sets.where("rep is not null").select("id", "rep").distinct(), "id").select("key", F.col("rep").alias("id"), "n").distinct()
    tiles = written(tiles, shared.count())
    forget(shared)
    most = tiles.count()
    # shingles that have the same documents are one: the digest of a shingle's documents doesn't depend on their order
    centre = F.min(F.struct(F.xxhash64("id", F.pmod("key", F.lit(CENTRES))).alias("h"), "id", "n"))
    ids = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (11, 12)]
    shingle = tiles.groupBy("key").agg(F.count("*").alias("m"), centre.alias("c"), *ids).where("m > 1")
    shingle = shingle.groupBy("m", "x11", "x12").agg(F.min(F.struct("key", "c")).alias("k"))
    shingle = written(shingle.select("k.key", F.col("k.c.id").alias("cid"), F.col("k.c.n").alias("cn")), most // 2)
    named = written(skew_join(tiles, shingle, ["key"], ["id"]), most)
    forget(tiles, shingle)
    tiles = named
    texts = docs.where("id is not null").join(tiles.select("id").distinct(), "id", "left_semi")
    texts = written(texts, text_bytes=WORD_BYTES * total["words"])

    near = (F.least("n", "cn") * den >= F.greatest("n", "cn") * num) & (F.col("id") != F.col("cid"))
    pairs = written(tiles.where(near).select(F.col("id").alias("u"), F.col("cid").alias("v")).distinct(), most)
    possible_ = written(_possible(pairs, nodes, num, den), most)
    roots = components(_verified(possible_, texts, size, num, den), n_rows)
    forget(pairs, possible_)

    left = tiles.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("root", "id").alias("comp"))
    every = left = written(left, most)
    forget(tiles)
    open_ = left.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    left = written(left.join(open_, "key", "left_semi").withColumn("band", _band(F.col("n"), num, den)), most)
    forget(every)
    named = F.when(F.count("*") <= TILE_KEYS, F.sort_array(F.collect_list("key"))).alias("keys")
    facts_of = left.groupBy("id").agg(named).join(nodes.select("id", "bits"), "id")
    rows = _tiled(left, "key", F.ceil(F.count("*") / TILE_ROWS).cast("int"), 0)
    rows = rows.join(facts_of, "id").select("key", "tile.bi", "tile.bj", "n", "id", "comp", "block", "bits", "keys")
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "n")
    pairs = written(_tiles(rows, num, den).distinct(), most)
    forget(left)
    more = _verified(pairs, texts, size, num, den)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more), n_rows)
    forget(pairs)
    links = written(_links(roots, nodes, texts, size, num, den, n_rows), n_rows)
    forget(texts)
    roots = roots.join(links.withColumnRenamed("id", "node"), "node", "full_outer")

    out = sets.join(roots, F.col("rep") == F.col("node"), "left")
    count = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0).cast("long"))).alias("n_links")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("root", "rep", "id").alias("component_id"), count)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("n_links")  # the SQL has components only


#: Exact sets, all pairs that share a shingle, and reachability, as DuckDB SQL for tables of moderate size.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shs FROM w),
s AS (SELECT doc_id, unnest(shs) AS sh FROM l),
n AS (SELECT doc_id, len(shs) AS n FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT node, MIN(reached) AS component_id FROM r GROUP BY 1)
SELECT l.doc_id, CAST(len(shs) AS BIGINT) AS n_shingles, CASE WHEN len(shs) = 0 THEN l.doc_id ELSE MIN(l.doc_id) OVER (PARTITION BY shs) END AS class_id, component_id
FROM l JOIN c ON c.node = l.doc_id
"""

QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLE = {"op1_ngram_jaccard_join": SQL}
