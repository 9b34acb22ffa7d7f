"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models on hashed text; each model also gets the probabilities of
the categories before it. In training those are out-of-fold predictions, so a later model learns how far an earlier one
can be trusted on texts it has not seen. The last link is ``toxic``.

The categories are columns of the labels. Labels that have ``toxic`` only get earlier categories derived from them: the
TELLING words that tell toxic rows from the rest the most are dealt in turn to ``derived_1`` and ``derived_2``, and a toxic
text belongs to those whose words it has. Training takes at most TRAIN_ROWS labelled rows; every feature they have is weighed.

Defined results: a null text scores as an empty one; without labelled rows of both kinds every probability is next to 0
(or 1 if all are toxic) and without toxic rows nothing is toxic; rows that repeat give rows that repeat; a null id is
carried; other columns are ignored; an empty table gives no rows; equal scores get equal verdicts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, table
from .textmodel import FEATURES, FOLDS, Featurizer, Rows, descend, featurizer, fold_of, labelled, sigmoid, sums

#: Words from which earlier categories are derived where labels have none.
TELLING = 10
DERIVED = ("derived_1", "derived_2")
LAST = "toxic"


@dataclass
class Link:
    weights: np.ndarray
    dense: np.ndarray  # of the earlier links' probabilities
    bias: float


@dataclass
class Chain:
    names: list[str]
    links: list[Link]
    cut: float

    def __post_init__(self):
        self.weights = np.column_stack([x.weights for x in self.links]).astype(np.float32)

    def predict(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A column for each link: one sparse product for all links, then link after link."""
        s = sums(features, starts, self.weights)
        p = np.zeros_like(s)
        for k, link in enumerate(self.links):
            p[:, k] = sigmoid(s[:, k] + p[:, :k] @ link.dense + link.bias)
        return p


def _fit_link(features: list[np.ndarray], y: np.ndarray, dense: np.ndarray, use: np.ndarray) -> Link:
    weights = np.zeros(FEATURES, np.float32)
    if not y[use].any() or y[use].all():
        return Link(weights, np.zeros(dense.shape[1]), -9.0 if not y[use].any() else 9.0)
    rows, t = Rows(features, use), y[use].astype(float)
    rows.scale_by(y[use], power=2)
    by = _telling(dense[use], y[use])
    w, d, b = descend(rows, dense[use] * by, lambda s, e: ((g := sigmoid(s + e[0]) - t), np.array([g.sum()])), np.array([np.log((t.sum() + 1) / (len(t) - t.sum() + 1))]), l2=1e-2)
    weights[rows.features] = w
    return Link(weights, d * by, float(b[0]))


def _telling(dense: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scale of the earlier links' columns, as the features' is."""
    if not dense.shape[1]:
        return np.ones(0)
    error = np.sqrt(dense.var(axis=0) * (1 / max(1, y.sum()) + 1 / max(1, (~y).sum()))) + 1e-9
    z = np.abs(dense[y].mean(axis=0) - dense[~y].mean(axis=0)) / error
    return z * z / 4


def fit_chain(features: list[np.ndarray], categories: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """Links in the order of ``categories``; each sees the out-of-fold probabilities of those before it."""
    n = len(features)
    dense, links, out = np.zeros((n, 0)), [], np.zeros(n)
    flat = np.concatenate(features)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in features])[:-1]])
    for y in categories.values():
        y = np.asarray(y, bool)
        out = np.zeros(n)
        for f in range(FOLDS):
            if not (folds == f).any():
                continue
            part = _fit_link(features, y, dense, folds != f)
            s = sums(flat, starts, part.weights[:, None])[:, 0] + dense @ part.dense + part.bias
            out[folds == f] = sigmoid(s)[folds == f]
        links.append(_fit_link(features, y, dense, np.ones(n, bool)))
        dense = np.column_stack([dense, out])
    return Chain(list(categories), links, best_cut(out, np.asarray(list(categories.values())[-1], bool)))


def _odds(p):
    return np.log(p / (1 - p)) if 0 < p < 1 else np.sign(p - 0.5) * 30.0


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Between the scores where F1 is best on out-of-fold predictions; the middle of the widest such gap in log odds is taken."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0
    k = int(np.argmax(f1))
    high = _odds(p[order][k])
    low = _odds(p[order][k + 1]) if k + 1 < len(p) else high - 4
    return float(sigmoid((high + low) / 2))


def derived_categories(texts: list[str], toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Toxic texts by the words that tell them from the rest the most."""
    words = [set(t.lower().split()) for t in texts]
    words = [{w.strip(".,;:!?*#$%&|<>\"'") for w in ws} - {""} for ws in words]
    inside, outside = Counter(), Counter()
    for ws, t in zip(words, toxic, strict=True):
        (inside if t else outside).update(ws)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    gap = lambda w: inside[w] / n1 - outside[w] / n0
    top = sorted((w for w in inside if gap(w) > 0), key=lambda w: (-gap(w), w))[:TELLING]
    return {name: np.array([bool(t) and not ws.isdisjoint(top[k :: len(DERIVED)]) for ws, t in zip(words, toxic, strict=True)], bool) for k, name in enumerate(DERIVED)}


def fit(rows: list[dict], categories: Sequence[str] = ()) -> Chain:
    """rows: doc_id, text, toxic, and the ``categories`` that come before it in the chain, if the labels have any."""
    names = [*(categories or DERIVED), LAST]
    if not rows:
        return Chain(names, [Link(np.zeros(FEATURES, np.float32), np.zeros(k), -9.0) for k in range(len(names))], 1.1)
    toxic = np.array([r[LAST] == 1 for r in rows], bool)
    earlier = {c: np.array([r[c] == 1 for r in rows], bool) for c in categories} if categories else derived_categories([r["text"] for r in rows], toxic)
    return fit_chain(Featurizer().each([r["text"] for r in rows]), earlier | {LAST: toxic}, fold_of([r["doc_id"] for r in rows]))


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the chain's probabilities and the verdict for every row of ``docs``."""
    chain = Chain(chain.names, [Link(x.weights.astype(np.float32), x.dense, x.bias) for x in chain.links], chain.cut)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in chain.names], (LAST, pa.bool_())])

    def run(batches):
        make = featurizer()
        for b in batches:
            p = chain.predict(*make(b.column(1).to_pylist()))
            columns = [b.column(0), *[pa.array(p[:, k]) for k in range(len(chain.names))], pa.array(p[:, -1] >= chain.cut, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return arrow_pass(docs.select(docs[id_col].cast("long"), docs[text_col]), run, "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names) + f", {LAST} boolean")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit(labelled(docs, labels, [LAST])))


QUERIES = {"op2_toxicity_chain": op2_toxicity_chain}
ORACLE: dict[str, str] = {}
