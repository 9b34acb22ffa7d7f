"""Hashed text features and the sparse training that the toxicity and quality classifiers share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, held_by_process, id_hash

FEATURES = 1 << 18
#: Bounds of a fit: labelled rows (those with the least hash of doc_id) and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 4000, 32 << 20
FOLDS = 3
CACHE_TOKENS = 200_000
#: Features of a token: its shape, its word, the word's beginnings of 4 and 5 letters.
PER_TOKEN = 4

_SHAPES = str.maketrans({i: "A" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else chr(i) for i in range(256)})
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_UPPER, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>!"


def _h(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "replace")) & (FEATURES - 1)


def shape(token: str) -> str:
    """Kinds of characters in a token, each run once."""
    kinds = token.translate(_SHAPES)
    if not kinds.isascii():
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in kinds)
    return _RUN.sub(r"\1", kinds)


def token_features(token: str) -> tuple[int, int, int, int]:
    """FEATURES stands for none."""
    word = token.strip("\"'()[]{}.,;:!?*#$%&|<>-_ ").lower()
    first = _h("s" + shape(token))
    if not word:
        return first, FEATURES, FEATURES, FEATURES
    return first, _h("w" + word), _h("p" + word[:4]) if len(word) > 4 else FEATURES, _h("p" + word[:5]) if len(word) > 5 else FEATURES


class Featurizer:
    """Distinct hashed features of whole texts: words, their beginnings, shapes, and buckets of the text's own shape."""

    def __init__(self):
        self._forget()
        self.last = np.zeros(FEATURES + 1, np.int32)
        self.names: dict[tuple, int] = {}

    def _forget(self) -> None:
        self.tokens: dict[str, int] = {}
        self.table = np.empty((CACHE_TOKENS, PER_TOKEN), np.int32)

    def _rows_of(self, tokens: list[str]) -> np.ndarray:
        """The features of each of the distinct tokens."""
        at = np.fromiter((self.tokens.get(t, -1) for t in tokens), np.int64, len(tokens))
        out = np.empty((len(tokens), PER_TOKEN), np.int32)
        known = at >= 0
        out[known] = self.table[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = [token_features(tokens[k]) for k in new]
            if len(self.tokens) + len(new) > CACHE_TOKENS:
                self._forget()
            if len(new) <= CACHE_TOKENS:
                n = len(self.tokens)
                self.table[n : n + len(new)] = out[new]
                self.tokens.update(zip([tokens[k] for k in new], range(n, n + len(new)), strict=True))
        return out

    def _named(self, *name) -> int:
        v = self.names.get(name)
        if v is None:
            v = self.names[name] = _h(" ".join(map(str, name)))
        return v

    def _whole(self, text: str, n: int, distinct: int) -> list[int]:
        out = [self._named("length", n.bit_length())]
        if n:
            lines = [x for x in text.split("\n") if x.strip()]
            raw = text.encode("utf-8", "replace")
            upper, signs = (len(raw) - len(raw.translate(None, chars)) for chars in (_UPPER, _SIGNS))
            out += [
                self._named("distinct", 8 * distinct // n, n.bit_length()), self._named("lines", 8 * len(set(lines)) // max(1, len(lines))),
                self._named("upper", 10 * upper // len(text)), self._named("signs", 20 * signs // len(text)),
            ]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all texts one after another, and where each text's begin; every text has one at least."""
        texts = [t or "" for t in texts]
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        words = split.flatten()
        full = pc.not_equal(pc.binary_length(words), 0)
        named = words.filter(full).dictionary_encode()
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        edges = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        rows, index = self._rows_of(named.dictionary.to_pylist()), named.indices.to_numpy()
        seen = np.zeros(len(rows) + 1, np.int32)
        out, starts, size = [], [], 0
        for i, text in enumerate(texts):
            mine = index[edges[i] : edges[i + 1]]
            at = np.arange(len(mine), dtype=np.int32)
            seen[mine] = at
            mine = mine[seen[mine] == at]
            f = np.concatenate([rows[mine].ravel(), np.array(self._whole(text, len(at), len(mine)), np.int32)])
            at = np.arange(len(f), dtype=np.int32)
            self.last[f] = at
            f = f[(self.last[f] == at) & (f < FEATURES)]
            out.append(f)
            starts.append(size)
            size += len(f)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.array(starts, np.int64)

    def each(self, texts: list[str | None]) -> list[np.ndarray]:
        f, starts = self(texts)
        return np.split(f, starts[1:]) if len(starts) else []


def featurizer() -> Featurizer:
    return held_by_process("features", Featurizer)


def sums(features: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Presence rows times the weights (FEATURES x columns)."""
    if not len(starts):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[features], starts, axis=0, dtype=np.float64)


class Rows:
    """Sparse presence rows, by row and by column; a column for each feature that some row has."""

    def __init__(self, features: list[np.ndarray], use: np.ndarray | None = None):
        own = [f for k, f in enumerate(features) if use is None or use[k]]
        self.n = len(own)
        flat = np.concatenate(own) if own else np.empty(0, np.int32)
        self.features, col = np.unique(flat, return_inverse=True)
        self.k = len(self.features)
        self.col = col.astype(np.int32)
        sizes = [len(f) for f in own]
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if own else np.empty(0, np.int64)
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        order = np.argsort(self.col, kind="stable")
        self.row = row[order]  # by column
        self.at = np.searchsorted(self.col[order], np.arange(self.k))
        self.scale = np.ones(self.k)

    def scale_by(self, *labels: np.ndarray, power: int = 1) -> None:
        """Columns count by a power of how far their share differs between the rows with a label and the rest, in standard
        errors (the most over the labels). Every column stays; the penalty on weights then weighs on those that tell nothing."""
        c = np.add.reduceat(np.ones(len(self.row)), self.at) if self.k else np.empty(0)
        top = np.zeros(self.k)
        for y in labels:
            n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
            c1 = np.add.reduceat(y[self.row].astype(float), self.at) if self.k else c
            p = (c + 1) / (n1 + n0 + 2)
            top = np.maximum(top, np.abs(c1 / n1 - (c - c1) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
        self.scale = top * (top / 4) ** (power - 1)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat((w * self.scale).astype(np.float32)[self.col], self.start)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.add.reduceat(g.astype(np.float32)[self.row], self.at) * self.scale


def descend(rows: Rows, dense: np.ndarray, slope, start: np.ndarray, l2: float = 1e-3, steps: int = 60, rate: float = 0.03):
    """Adam on a convex loss. slope(score, extra) gives the loss's derivative by score and by the extra parameters.

    Parameters: a weight for each column of ``rows`` (times its scale), the dense columns' weights, the extra parameters
    (``start``)."""
    k, n, d = rows.k, rows.n, dense.shape[1]
    w = np.zeros(k + d + len(start))
    w[k + d :] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = rows.times(w[:k]) + dense @ w[k : k + d]
        gs, ge = slope(s, w[k + d :])
        g = np.concatenate([rows.back(gs) + l2 * n * w[:k], dense.T @ gs + l2 * n * w[k : k + d], ge]) / n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:k] * rows.scale, w[k : k + d], w[k + d :]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> list[dict]:
    """At most ``limit`` labelled rows with their texts, of TRAIN_BYTES together at most. Labels are chosen before texts are
    read; the chosen ids are broadcast."""
    ok = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(c).alias(c) for c in columns]).dropna()
    chosen = ok.orderBy(id_hash(id_col, 5), id_col).limit(limit)
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    return bounded_rows(texts.join(F.broadcast(chosen), id_col), id_col, "text", limit, TRAIN_BYTES, 5)


def fold_of(ids: list[int]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(str(i).encode()) % FOLDS for i in ids], int)
