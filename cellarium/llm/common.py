"""What the training-data operators share: shared-folder tables, word hashes, Arrow passes."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.storage import delete, scratch

#: Words one task keeps hashed; the cache starts anew beyond.
CACHE_WORDS = 300_000
#: Bytes of one Arrow batch, so that a few very long texts fit a Python worker.
BATCH_BYTES = 8 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one file of a table of short rows; bytes of one file of texts.
FILE_ROWS, FILE_BYTES = 400_000, 8_000_000


def in_files(df: DataFrame, files: int) -> DataFrame:
    """``df`` in ``files`` partitions at most, or two for each core. Every file that a task makes costs its executor a process
    or two where Hadoop has no native library, whatever the file holds."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, files))


def release() -> None:
    """Gives the system back what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def written(df: DataFrame, rows: int | None = None, compression: str = "snappy", text_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: lineage ends there and no executor holds the only copy.

    ``rows``: about how many rows of a few bytes come out of a shuffle; their files follow from it, two for each core at
    least. ``text_bytes``: the same for rows with texts. Else every partition writes its own. The table goes with ``forget``, or
    when the driver's Python ends.
    """
    spark = df.sparkSession
    release()  # what the driver's own fits and lists have left
    if rows is not None:
        df = in_files(df, -(-rows // FILE_ROWS))
    elif text_bytes is not None:
        df = in_files(df, -(-text_bytes // FILE_BYTES))
    path = scratch(spark, "table")
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what came from them is written itself."""
    for t in tables:
        delete(t.sparkSession, t._written_at)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, which need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="cellarium-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))


def arrow_pass(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes. Workers live on beside the JVM, so a pass that has ended releases its memory."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def id_hash(c: str | Column, seed: int = 0) -> Column:
    """A hash of an id, the same on every run."""
    return F.xxhash64(F.col(c) if isinstance(c, str) else c, F.lit(seed))


#: A key is hot with more than one in HOT_SHARE of the rows, and more than HOT_LEAST: then there are few hot keys, whatever the size.
HOT_SHARE, HOT_LEAST = 10_000, 256


def skew_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """A join where keys may have very many rows in ``left`` and have few in ``right``. ``left`` should be a written table.

    Keys are counted first. The rows of a hot key are dealt over parts of HOT_SHARE-th of all rows by the hash of ``by``;
    the right rows of that key go to each of its parts, some 2 * HOT_SHARE copies in all. Only the hot keys and their
    numbers of parts are broadcast.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_c"))
    most = max(HOT_LEAST, left.count() // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("_c") > most).select(*on, F.ceil(F.col("_c") / most).cast("int").alias("_parts")))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def bounded_rows(rows: DataFrame, id_col: str, text_col: str, limit: int, most_bytes: int, seed: int) -> list[dict]:
    """For fitting: at most ``limit`` different rows whose texts have ``most_bytes`` bytes together at most, those with the least
    hash of the id; a text that doesn't fit any more is passed over. Sorted by id, then the hash of the row."""
    keyed = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("_h", F.xxhash64(*rows.columns))
    keys = keyed.select(id_col, "_h", F.octet_length(text_col).alias("_n")).distinct().orderBy(id_hash(id_col, seed), id_col, "_h").limit(limit).collect()
    left, chosen = most_bytes, []
    for k in keys:
        if k["_n"] <= left:
            left -= k["_n"]
            chosen.append((k[0], k["_h"]))
    if not chosen:
        return []
    few = rows.sparkSession.createDataFrame(chosen, keyed.select(id_col, "_h").schema)
    found = keyed.join(F.broadcast(few), [id_col, "_h"]).dropDuplicates([id_col, "_h"]).toArrow().to_pylist()
    found.sort(key=lambda r: (r[id_col], r.pop("_h")))
    return found


class WordHash(dict):
    """64-bit hashes of words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_held: dict[str, object] = {}


def held_by_process(kind: str, make: Callable[[], object]):
    """A cache that lives on from task to task, as Python workers do. A worker holds one kind at a time."""
    if kind not in _held:
        _held.clear()
        _held[kind] = make()
    return _held[kind]


def word_hash() -> WordHash:
    return held_by_process("words", WordHash)


def ascii_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z in lower case; bytes' own split() and lower() are just that."""
    return (text or "").encode("utf-8", "replace").lower().split()


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, in order; none when there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out ^ hashes[j : j + n]) * _MUL
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's ``size``-word shingles; with fewer words the whole sequence is one."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
