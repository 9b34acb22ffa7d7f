"""Quality classifier: ordinal cumulative-link regression.

One vector of weights on hashed text and ordered thresholds: P(grade >= k) is the logistic of (score - threshold k).
Gives the expected grade and the tail probability on which rows are selected.

The grades come from ``labels``: 0 poor, 1 good but toxic, 2 good and clean. Training takes at most TRAIN_ROWS labelled
rows; every feature they have is weighed.

Defined results: a null text scores as an empty one; without two grades among the labelled rows every text gets the one
grade there is (or the highest) for certain; rows that repeat give rows that repeat; a null id is carried; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, batch_of, table
from .textmodel import FEATURES, Featurizer, Rows, descend, featurizer, labelled, sigmoid, sums

GRADES = 3
#: Selected: P(grade >= TAIL_GRADE) of TAIL at least, and an expected grade of EXPECTED at least.
TAIL_GRADE, TAIL, EXPECTED = 1, 0.5, 1.0


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray  # ascending

    def tails(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of every text."""
        return sigmoid(sums(features, starts, self.weights[:, None]) - self.cuts)


def cumulative_slope(y: np.ndarray, grades: int):
    """Derivatives of the negative log likelihood by score and by (first threshold, log of each step to the next)."""

    def slope(s, e):
        cuts = np.concatenate([[e[0]], e[0] + np.cumsum(np.exp(e[1:]))])
        tail = np.column_stack([np.ones(len(s)), sigmoid(s[:, None] - cuts), np.zeros(len(s))])
        at = np.arange(len(s))
        hi, lo = tail[at, y], tail[at, y + 1]
        p = np.maximum(hi - lo, 1e-12)
        gs = -(1 - hi - lo)
        by_cut = np.zeros(grades - 1)
        for k in range(1, grades):
            t = tail[:, k] * (1 - tail[:, k])
            by_cut[k - 1] = (t / p)[y == k].sum() - (t / p)[y == k - 1].sum()
        ge = np.array([by_cut.sum(), *[by_cut[k:].sum() * np.exp(e[k]) for k in range(1, grades - 1)]])
        return gs, ge

    return slope


def fit(features: list[np.ndarray], grades: np.ndarray, levels: int = GRADES) -> Ordinal:
    weights = np.zeros(FEATURES, np.float32)
    grades = np.asarray(grades, int)
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else levels - 1
        return Ordinal(weights, np.where(np.arange(1, levels) <= only, -30.0, 30.0))
    rows = Rows(features)
    rows.scale_by(*[grades >= k for k in range(1, levels)])
    share = np.clip([(grades >= k).mean() for k in range(1, levels)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    start = np.concatenate([[cuts[0]], np.log(np.maximum(0.1, np.diff(cuts)))])
    w, _, e = descend(rows, np.zeros((rows.n, 0)), cumulative_slope(grades, levels), start)
    weights[rows.features] = w
    return Ordinal(weights, np.concatenate([[e[0]], e[0] + np.cumsum(np.exp(e[1:]))]))


def grade(quality: int, toxic: int) -> int:
    return 0 if quality != 1 else 1 if toxic == 1 else 2


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_tail", pa.float64()), ("selected", pa.bool_())])


def score_quality(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", tail_grade: int = TAIL_GRADE, tail: float = TAIL, expected: float = EXPECTED) -> DataFrame:
    """doc_id, expected grade, tail probability and selection for every row of ``docs``."""

    def run(batches):
        make = featurizer()
        for b in batches:
            t = model.tails(*make(b.column(1).to_pylist()))
            p, mean = t[:, tail_grade - 1], t.sum(axis=1)
            yield batch_of(_SCHEMA, doc_id=b.column(0), expected_grade=mean, p_tail=p, selected=(p >= tail) & (mean >= expected))

    return arrow_pass(docs.select(docs[id_col].cast("long"), docs[text_col]), run, "doc_id long, expected_grade double, p_tail double, selected boolean")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = labelled(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return score_quality(docs, fit(Featurizer().each([r["text"] for r in rows]), np.array([grade(r["quality"], r["toxic"]) for r in rows], int)))


QUERIES = {"op10_ordinal_quality": op10_ordinal_quality}
ORACLE: dict[str, str] = {}
