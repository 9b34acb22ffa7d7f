"""Language identification by a string kernel.

A text's blended spectrum is the set of its letter n-grams of 2 to 4 code points, all of them, hashed to BUCKETS. The
presence kernel of two texts is the number of n-grams that both have over the root of their numbers' product. Kernels
against landmark texts are mapped by Nystroem (the inverse root of the landmark kernel), and one-versus-rest kernel ridge
regression gives a score for each language. An n-gram that no landmark has adds nothing to any kernel but the text's norm,
so a batch is scored by a product of its sparse presence rows with the landmarks' columns times the weights.

The score is the softmax of the languages' scores, times the part of the text's n-grams that a landmark has where that is
under KNOWN: letters of an alphabet that was never learned are given a language, as they have to be, for next to nothing.

Training takes at most TRAIN_ROWS labelled rows of TRAIN_BYTES bytes, those with the least hash of doc_id.

Defined results: a null text or one without letters is ``und`` with score 0, as is every text when nothing was learned;
rows that repeat give rows that repeat; a null id is carried; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, batch_of, bounded_rows, held_by_process, table

NGRAMS = (2, 3, 4)
BUCKETS = 1 << 20
#: Bounds of the fit: labelled rows, bytes of their texts, landmarks; ridge.
TRAIN_ROWS, TRAIN_BYTES, LANDMARKS, RIDGE = 3000, 32 << 20, 128, 1e-3
#: Part of a text's n-grams from which on its score stands as it is.
KNOWN = 0.25
#: Softmax temperature of the ridge scores.
TEMPERATURE = 0.15
BATCH_CHARS = 400_000
UNDETERMINED = "und"

_LETTER = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x10000)])
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def letters(text: str) -> np.ndarray:
    """Code points in lower case; what isn't a letter is one space (0), and the text starts and ends with one."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = cp < 0x10000
    keep = np.where(low, _LETTER[np.where(low, cp, 0)], True)
    if not low.all():
        keep[~low] = [unicodedata.category(chr(c))[0] == "L" for c in cp[~low]]
    x = np.where(keep, cp, 0).astype(np.uint64)
    x = np.concatenate([[np.uint64(0)], x, [np.uint64(0)]])
    return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]


def grams(x: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of the letters (with the spaces around words)."""
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, NGRAMS[-1] + 1):
        if len(x) < n:
            break
        m = len(x) - n + 1
        h = (h[:m] * _P1) ^ (x[n - 1 :] + np.uint64(n))
        if n in NGRAMS:
            out.append((((h + np.uint64(n)) * _P2) >> np.uint64(44)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Spectrum:
    """The different n-grams of a text: each place writes its number at its n-gram, and the last one there counts."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)

    def of(self, x: np.ndarray) -> np.ndarray:
        g = grams(x)
        at = np.arange(len(g), dtype=np.int32)
        self.last[g] = at
        return g[self.last[g] == at]


@dataclass
class Model:
    langs: list[str]
    index: np.ndarray  # bucket -> feature (an n-gram of a landmark) or -1
    landmarks: np.ndarray  # features x landmarks, of unit columns
    weights: np.ndarray  # landmarks x languages: inverse root times ridge weights

    def __post_init__(self):
        # a last row of zeros, for n-grams of no landmark
        self.columns = np.vstack([self.landmarks @ self.weights, np.zeros((1, self.weights.shape[1]))]).astype(np.float32)

    def slim(self) -> Model:
        """What predictions need, for the executors."""
        out = Model([], np.empty(0, np.int32), np.zeros((0, 0)), np.zeros((0, 0)))
        out.langs, out.index, out.columns = self.langs, self.index, self.columns
        return out

    def product(self, spectra: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence rows of unit length times ``columns``, and which part of each text's n-grams a landmark has."""
        sizes = np.array([len(g) for g in spectra])
        f = self.index[np.concatenate(spectra)]
        edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        known = np.add.reduceat((f >= 0).astype(np.int64), edges) / sizes
        return np.add.reduceat(columns[f], edges, axis=0) / np.sqrt(sizes)[:, None], known

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        held: list[tuple[int, np.ndarray]] = []
        size, spectrum = 0, held_by_process("spectrum", Spectrum)

        def flush():
            if not held:
                return
            s, known = self.product([g for _, g in held], self.columns)
            e = np.exp((s - s.max(axis=1, keepdims=True)) / TEMPERATURE)
            e /= e.sum(axis=1, keepdims=True)
            for (i, _), k, p in zip(held, e.argmax(axis=1), e.max(axis=1) * np.minimum(1, known / KNOWN), strict=True):
                langs[i], scores[i] = self.langs[k], float(p)
            held.clear()

        for i, text in enumerate(texts):
            x = letters(text) if text else ()
            if len(x) < 3:  # the spaces around make two
                continue
            held.append((i, spectrum.of(x)))
            size += len(x)
            if size >= BATCH_CHARS or len(held) >= 256:
                flush()
                size = 0
        flush()
        return langs, scores


def fit(texts: list[str | None], langs: list[str]) -> Model:
    names = sorted(set(langs))
    index = np.full(BUCKETS, -1, np.int32)
    spectrum = Spectrum()
    rows = [(spectrum.of(x).astype(np.int32), names.index(lang)) for t, lang in zip(texts, langs, strict=True) if t and len(x := letters(t)) >= 3]
    if not rows:
        return Model([], index, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    spectra = [g for g, _ in rows]
    y = np.array([k for _, k in rows])
    # landmarks: in turn from each language, long texts first
    turns = [sorted(np.flatnonzero(y == k), key=lambda i: (-len(spectra[i]), i)) for k in range(len(names))]
    marks = [t[r] for r in range(max(map(len, turns))) for t in turns if r < len(t)][:LANDMARKS]
    every = np.unique(np.concatenate([spectra[i] for i in marks]))
    index[every] = np.arange(len(every))
    land = np.zeros((len(every), len(marks)), np.float32)
    for c, i in enumerate(marks):
        land[index[spectra[i]], c] = 1 / np.sqrt(len(spectra[i]))
    value, vector = np.linalg.eigh((land.T @ land).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    blank = Model(names, index, land, np.zeros((len(marks), len(names))))
    columns = np.vstack([land, np.zeros((1, len(marks)), np.float32)])
    z = np.concatenate([blank.product(spectra[i : i + 16], columns)[0] for i in range(0, len(spectra), 16)]).astype(float) @ root
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # each language weighs the same
    weight *= len(y) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    ridge = np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * len(y) * np.eye(z.shape[1]), (z * weight[:, None]).T @ target)
    return Model(names, index, land, root @ ridge)


def training_rows(docs: DataFrame, where, id_col: str, text_col: str, lang_col: str, limit: int = TRAIN_ROWS) -> tuple[list, list]:
    """Texts and languages of at most ``limit`` rows of at most TRAIN_BYTES together."""
    ok = docs.where(where & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    rows = bounded_rows(ok, id_col, text_col, limit, TRAIN_BYTES, 8)
    return [r[text_col] for r in rows], [r[lang_col] for r in rows]


def held_out(id_col: str):
    """The fold no model sees: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(*training_rows(docs, ~held_out(id_col), id_col, text_col, lang_col))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    model = model.slim()

    def run(batches):
        for b in batches:
            langs, scores = model.predict(b.column(2).to_pylist())
            yield batch_of(_SCHEMA, doc_id=b.column(0), held_out=b.column(1), lang_pred=langs, score=scores)

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out(id_col), F.lit(False)), F.col(text_col))
    return arrow_pass(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with a score of ``least`` at least."""
    at, model = docs.columns.index(text_col), model.slim()

    def run(batches):
        for b in batches:
            langs, scores = model.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return arrow_pass(docs, run, docs.schema)


def op8_kernel_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_documents(docs))


QUERIES = {"op8_kernel_language_id": op8_kernel_language_id}
ORACLE: dict[str, str] = {}
