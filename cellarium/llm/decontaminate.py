"""Benchmark decontamination by greedy string tiling.

1. Every run of LEAST words of an item is a seed. A bitmap of bounded size of all seeds lets one pass over the documents
   pass on only those that may share one, with their seeds.
2. A Spark join of these seeds with the items' names the pairs. An item that tiles cover has matches at so many places that
   its most frequent seeds aren't needed to find it, so they open no pairs.
3. For each pair the longest unmarked match is found and marked again and again, by running Karp-Rabin hashes whose hits
   are compared word by word, until none has the least length; tiles don't overlap, so each word of the item counts once.
   A document is contaminated when tiles cover enough of an item, in whatever order its passages stand.

The benchmark may be of any size; the documents are read once. Words are compared in lower case without the punctuation
around them.

Defined results: a null or empty text or item matches nothing; an item of fewer words than a seed has to occur whole;
rows that repeat give rows that repeat, on both sides; rows without doc_id are carried; items without item_id don't count;
other columns are ignored (``drop_contaminated`` keeps them, whatever their names); an empty table on either side gives no
rows (and drops none).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE_WORDS, arrow_pass, ascii_words, held_by_process, mixed, skew_join, table, windows, written

#: Words of a seed, which is also the least tile.
LEAST = 5
#: Share of an item's words that tiles have to cover.
COVERAGE = 0.6
#: Bits of the seeds' bitmap: so many for a seed, as a power of two, and at most 1 << MOST_BITS (16 MB); places that a seed sets.
SEED_BITS, MOST_BITS, PLACES = 64, 27, 4
#: Contaminated texts whose digests are broadcast when documents are dropped (about 40 bytes each); beyond, a shuffle join.
DROPPED = 1_000_000

_PUNCT = b".,;:!?\"'()[]{}<>*#$%&|-_"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def clean(words: list[bytes]) -> list[bytes]:
    return [x for w in words if (x := w.strip(_PUNCT))]


class Running:
    """Running Karp-Rabin hashes: of any window of a sequence in constant time, modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, _BASE, np.uint64), out=self.power[1:]) if n else None
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64)) * self.power[:n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        # brought to one common power, so that equal windows at different places hash alike
        return (self.sums[size:] - self.sums[:-size]) * self.power[: n][::-1]


def _same(a: Running, b: Running, size: int, free_a: np.ndarray, free_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of windows without marks, in both sequences."""
    ha, hb = a.windows(size), b.windows(size)
    # windows of a were brought to power len(ha) - 1, those of b to len(hb) - 1
    if len(ha) < len(hb):
        ha = ha * b.power[len(hb) - len(ha)]
    elif len(hb) < len(ha):
        hb = hb * a.power[len(ha) - len(hb)]
    oa = np.flatnonzero(free_a[size:] - free_a[:-size] == 0)
    ob = np.flatnonzero(free_b[size:] - free_b[:-size] == 0)
    return ha[oa], oa, hb[ob], ob


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiling, longest first. Negative ids match nothing."""
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    a, b = Running(doc + 2), Running(item + 2)
    mark_a, mark_b = (doc < 0).astype(np.int64), (item < 0).astype(np.int64)
    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while True:
        free_a, free_b = (np.concatenate([[0], np.cumsum(m)]) for m in (mark_a, mark_b))

        def match(size, free_a=free_a, free_b=free_b):
            ha, oa, hb, ob = _same(a, b, size, free_a, free_b)
            good = np.isin(ha, hb)
            return (ha[good], oa[good], hb, ob) if good.any() else None

        found = match(least)
        if found is None:
            return out
        low, high = least, most
        while low < high:  # the longest length that still matches
            mid = (low + high + 1) // 2
            longer = match(mid)
            if longer is None:
                high = mid - 1
            else:
                low, found = mid, longer
        marked = False
        places: dict[int, list[int]] = {}
        for h, o in zip(found[2].tolist(), found[3].tolist(), strict=True):
            places.setdefault(h, []).append(o)
        for h, o in zip(found[0].tolist(), found[1].tolist(), strict=True):
            if mark_a[o : o + low].any():
                continue
            for p in places[h]:
                if not mark_b[p : p + low].any() and (doc[o : o + low] == item[p : p + low]).all():
                    marked = True
                    out.append((o, p, low))
                    mark_a[o : o + low] = 1
                    mark_b[p : p + low] = 1
                    break
        most = low if marked else low - 1  # equal hashes of different words
        if most < least:
            return out


class Index:
    """Seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST):
        self.least = least
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for i, text in items:
            words = clean(ascii_words(text))
            if words:
                self.items.append((i, np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int64)))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, x) in enumerate(self.items):
            size = min(least, len(x))
            h = _seed_hashes(x, size)
            by.setdefault(size, []).append((h, np.full(len(h), k)))
        for size, parts in by.items():
            h, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], k[order]

    def matches(self, ids: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of the items covered."""
        near: dict[int, list[tuple[int, int]]] = {}
        for size, (h, k) in self.seeds.items():
            if len(ids) < size:
                continue
            good = np.concatenate([[0], np.cumsum(ids < 0)])
            at = np.flatnonzero(good[size:] - good[:-size] == 0)
            if not len(at):
                continue
            mine = _seed_hashes(ids, size)[at]
            lo, hi = np.searchsorted(h, mine, side="left"), np.searchsorted(h, mine, side="right")
            for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for item in set(k[x:y].tolist()):
                    near.setdefault(item, []).append((p, p + size))
        out = []
        for item, spans in near.items():
            i, x = self.items[item]
            # tiles consist of seeds, so only the runs of seeds matter
            runs: list[list[int]] = []
            for s, e in sorted(spans):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(e, runs[-1][1])
                else:
                    runs.append([s, e])
            parts = []
            for s, e in runs:
                parts += [ids[s:e], np.array([-1])]
            found = tiles(np.concatenate(parts), x, self.least)
            share = sum(t[2] for t in found) / len(x)
            if share >= coverage:
                out.append((i, share, len(found), found[0][2]))
        return sorted(out)


def _seed_hashes(x: np.ndarray, size: int) -> np.ndarray:
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    y = mixed((x + 2).astype(np.uint64))
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * _BASE + y[j : j + n]
    return h


class _Cleaned(dict):
    """64-bit hash of a word without the punctuation around it, by the raw word; 0 for punctuation by itself."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        x = word.strip(_PUNCT)
        v = self[word] = (xxhash.xxh64_intdigest(x) or 1) if x else 0
        return v


def _hashes(words: _Cleaned, text: str | None) -> np.ndarray:
    found = ascii_words(text)
    x = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    return x[x != 0]


def seeds_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; runs of other sizes hash apart."""
    return windows(hashes, size) ^ np.uint64(size * 0x9E3779B9)


_SEEDS = pa.schema([("k", pa.int64()), ("pos", pa.int32()), ("need", pa.int32()), ("size", pa.int32()), ("h", pa.int64())])


def _seeds(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Per item and place its seed; ``need``: how many of the item's rarest places any covered item has a match among."""

    def run(batches):
        words = held_by_process("cleaned words", _Cleaned)
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _hashes(words, text)
                size = min(least, len(x))
                if size:
                    h = seeds_of(x, size)
                    matched = max(1, -(-int(np.ceil(coverage * len(x) - 1e-9)) // size))  # every tile has a seed at least
                    out.append((np.full(len(h), k), np.arange(len(h)), np.full(len(h), max(1, len(h) - matched + 1)), np.full(len(h), size), h.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), _SEEDS, strict=True)], schema=_SEEDS)

    return arrow_pass(items.select("k", "text"), run, "k long, pos int, need int, size int, h long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds: PLACES bits for each, from its hash turned by 16 bits a time; its words come combined
    from the executors."""
    n = seeds.count()
    bits = min(MOST_BITS, max(10, (SEED_BITS * n - 1).bit_length()))
    h = F.col("h")
    turned = [h if not k else F.shiftrightunsigned(h, 16 * k).bitwiseOR(F.shiftleft(h, 64 - 16 * k)) for k in range(PLACES)]
    rows = seeds.select(F.explode(F.array(*[t.bitwiseAND(F.lit((1 << bits) - 1)) for t in turned])).alias("b"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    rows = rows.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit).alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("x").to_numpy().view(np.uint64)
    return out


def _maybe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes whose bits are all set."""
    mask = np.uint64(64 * len(bitmap) - 1)
    for k in range(PLACES):
        at = (h if not k else (h >> np.uint64(16 * k)) | (h << np.uint64(64 - 16 * k))) & mask
        h = h[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0]
        if not len(h):
            break
    return h


_HITS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.int64()))])


def _hits(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """The documents that have runs of words whose bit is set, and these runs' hashes, each once."""
    def run(batches):
        words = held_by_process("cleaned words", _Cleaned)
        for b in batches:
            keep, hits = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                x = _hashes(words, text)
                found = []
                for size in sizes:
                    h = _maybe(bitmap, seeds_of(x, size))
                    if len(h):
                        found.append(h)
                if found:
                    keep.append(i)
                    hits.append(np.unique(np.concatenate(found)).view(np.int64))
            if keep:
                edges = np.concatenate([[0], np.cumsum([len(h) for h in hits])])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(hits)))
                some = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1).cast(pa.string()), lists], schema=_HITS)

    return arrow_pass(docs, run, "doc_id long, text string, hits array<long>")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("r", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])


def _matches(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, least: int, coverage: float) -> tuple[DataFrame, DataFrame] | None:
    """docs: doc_id, text. The documents that may match, by row r, and (doc_id, r, item_id, coverage, n_tiles,
    longest_tile) of those that do; None without items."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = written(items.withColumn("k", F.monotonically_increasing_id()))
    seeds = written(_seeds(items, least, coverage))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # least at most
    if not sizes:
        return None
    near = written(_hits(docs, _bitmap(seeds), sizes).withColumn("r", F.monotonically_increasing_id()))
    hits = written(near.select("r", F.explode("hits").alias("h")))
    often = hits.groupBy("h").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("k").orderBy("df", "h", "pos"))
    found = seeds.join(often, "h", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rarest)
    found = found.where((F.col("rank") <= F.col("need")) & (F.col("df") > 0)).select("h", "k").distinct()
    pairs = written(skew_join(hits, found, ["h"], ["r"]).select("r", "k").distinct())
    rows = skew_join(pairs, items, ["k"], ["r"]).withColumnRenamed("text", "item")
    rows = skew_join(rows.select("r", "k", "item_id", "item"), near.select("r", "doc_id", "text"), ["r"], ["k"]).select("doc_id", "r", "k", "item_id", "item", "text")

    def run(batches):
        held = lru_cache(maxsize=256)(lambda k, i, item: Index([(i, item)], least))
        words = lru_cache(maxsize=16)(lambda text: clean(ascii_words(text)))
        for b in batches:
            out = []
            for doc, r, k, i, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index = held(k, i, item)
                x = words(text)
                ids = np.fromiter((index.ids.get(w, -1) for w in x), np.int64, len(x))
                out += [(doc, r, *m) for m in index.matches(ids, coverage)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    return near, arrow_pass(rows, run, "doc_id long, r long, item_id long, coverage double, n_tiles long, longest_tile long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that it contains: coverage, number of tiles, longest tile."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = _matches(rows, benchmark, item_col, item_text, least, coverage)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, n_tiles long, longest_tile long")
    return found[1].drop("r")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = _matches(rows, benchmark, item_col, item_text, least, coverage)
    if found is None:
        return docs
    near, matches = found
    # texts decide, so digests of the matching texts do
    digest = lambda c: F.struct(F.xxhash64(c), F.xxhash64(c, F.lit(1)), F.octet_length(c))
    gone = written(near.join(matches.select("r").distinct(), "r", "left_semi").select(digest(F.col("text")).alias("_digest")).distinct(), 0)
    gone = F.broadcast(gone) if gone.count() <= DROPPED else gone
    return docs.join(gone, digest(docs[text_col]) == gone["_digest"], "left_anti")


def op5_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_greedy_tiling": op5_greedy_tiling}
ORACLE: dict[str, str] = {}
