"""Quality rules by compression bands.

zstandard's ratio (compressed bytes to bytes) of the whole text and of its fixed chunks has to lie in a band that depends
on the length. Repetitive text falls below its band, incompressible text above. Every count is over the whole text.

Defined results: a null text has no words; a text of under 20 words fails the base; rows that repeat give rows that
repeat; a null id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import WordHash, arrow_pass, batch_of, table, windows, word_hash

LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes below which the band holds, least ratio, most ratio). Short texts have frame overhead, long ones more context.
BANDS = (
    (64, 0.0, float("inf")),
    (256, 0.42, float("inf")),
    (1024, 0.36, 0.86),
    (4096, 0.34, 0.68),
    (16384, 0.33, 0.60),
    (float("inf"), 0.30, 0.56),
)
#: A text goes when chunks outside their bands hold more than this share of its bytes.
CHUNK_SHARE = 0.25
REPEAT_WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64())]
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def repeat_words(hashes: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """How many words lie in a window of ``size`` words that the text has twice or more."""
    h = windows(hashes, size)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    low, high = next((low, high) for below, low, high in bands if n_bytes < below)
    return low <= ratio <= high


def measure(text: str | None, words_hash: WordHash, compressor: zstandard.ZstdCompressor, bands=BANDS) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunk_share)."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeat = repeat_words(words_hash.of(words)) if n > REPEAT_WINDOW else 0
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    ratio = len(compressor.compress(raw)) / len(raw) if raw else 0.0
    bad = 0
    if len(raw) > CHUNK_BYTES:
        for i in range(0, len(raw), CHUNK_BYTES):
            chunk = raw[i : i + CHUNK_BYTES]
            if not in_band(len(chunk), len(compressor.compress(chunk)) / len(chunk), bands):
                bad += len(chunk)
    share = bad / len(raw) if raw else 0.0
    kept = not failed and in_band(len(raw), ratio, bands) and share <= CHUNK_SHARE
    return n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeat, failed, kept, ratio, share


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS) -> DataFrame:
    """Base counts and the verdict for every row of ``docs``."""

    def run(batches):
        words, compressor = word_hash(), zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = [measure(t, words, compressor, bands) for t in b.column(1).to_pylist()]
            cols = dict(zip(_SCHEMA.names[1:], zip(*rows), strict=True)) if rows else {c: [] for c in _SCHEMA.names[1:]}
            yield batch_of(_SCHEMA, doc_id=b.column(0), **cols)

    return arrow_pass(docs.select(docs[id_col].cast("long"), docs[text_col]), run, SCHEMA)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


QUERIES = {"op9_compression_bands": op9_compression_bands}
ORACLE: dict[str, str] = {}
