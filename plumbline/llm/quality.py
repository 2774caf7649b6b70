"""Document quality by ordinal cumulative-link regression (operator 3).

Graded ratings 0 < 1 < ... < K-1 share one weight vector over hashed text
features; ordered thresholds cut the latent quality:
``P(grade <= k) = sigmoid(theta_k - w.x)`` with ``theta_0 < theta_1 < ...``.
That gives an expected grade and the tail probability of any grade, which is
what selection uses.

Features are the shares of hashed words and word beginnings in a fixed number
of slots plus a few shares of character classes, so they have one scale for
short and long texts. The fit uses a bounded sample of the rated rows
(``max_rows``) on one executor; scoring reads whole texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.terms import words_of
from plumbline.llm.toxicity import fitted, sampled

SLOTS = 1_024
SHAPES = 12
MAX_ROWS = 6_000


def features_of(text: str | None) -> np.ndarray:
    """``SLOTS`` signed word shares of unit length, then ``SHAPES`` shape shares."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    own, starts = words_of(text, (4,))
    words = np.concatenate((own, starts))
    out = np.zeros(SLOTS + SHAPES)
    if len(words):
        sign = np.where(words >> np.uint64(63), 1.0, -1.0)
        slots = np.bincount((words % np.uint64(SLOTS)).astype(np.int64), sign, SLOTS)
        norm = np.sqrt((slots**2).sum())
        out[:SLOTS] = slots / norm if norm else slots
    if len(raw):
        kinds = np.bincount(raw, minlength=256) / len(raw)
        n_words = max(1, len(own))
        pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] if len(own) > 1 else own
        _, again = np.unique(own, return_counts=True)
        out[SLOTS:] = [
            kinds[0x41:0x5B].sum(),
            kinds[0x30:0x3A].sum(),
            kinds[0x21:0x30].sum() + kinds[0x3A:0x41].sum() + kinds[0x5B:0x61].sum() + kinds[0x7B:0x7F].sum(),
            kinds[[0x0A, 0x0D, 0x09]].sum() * 10,
            kinds[0x80:].sum(),
            min(1.0, len(raw) / n_words / 20),
            len(np.unique(own)) / n_words,
            1 - len(np.unique(pairs)) / max(1, len(pairs)),
            again.max() / n_words if len(again) else 0.0,
            kinds[0x7C] * 10,
            kinds[[0x23, 0x24, 0x25, 0x26, 0x2A, 0x2B, 0x3C, 0x3D, 0x3E, 0x40, 0x5E, 0x7E]].sum() * 10,
            min(1.0, np.log1p(n_words) / 10),
        ]
    return out


@dataclass
class Model:
    w: np.ndarray
    theta: np.ndarray  # increasing, one fewer than grades

    def tail(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; rows of ``x`` are documents."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - (x @ self.w)[:, None], -40, 40)))


def fit(x: np.ndarray, grades: np.ndarray, n_grades: int, l2: float = 1e-4, rounds: int = 400, rate: float = 0.3) -> Model:
    """Maximum penalised likelihood by Adam on all rows; deterministic.

    Thresholds stay ordered because all but the first are sums of exponentials.
    """
    n, k = len(grades), n_grades - 1
    w, free = np.zeros(x.shape[1]), np.zeros(k)
    share = np.array([(grades <= j).mean() if n else 0.5 for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(k) * 1e-3)
    free[0] = start[0]
    free[1:] = np.log(np.diff(start).clip(1e-3))
    if not n:
        return Model(w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))
    m, s = np.zeros(len(w) + k), np.zeros(len(w) + k)
    lo, hi = grades - 1, grades  # thresholds below and above a grade; outer ones are infinite
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        z = x @ w
        padded = np.concatenate(([-np.inf], theta, [np.inf]))
        a, b = padded[lo + 1] - z, padded[hi + 1] - z
        fa, fb = 1 / (1 + np.exp(-np.clip(a, -40, 40))), 1 / (1 + np.exp(-np.clip(b, -40, 40)))
        p = np.maximum(fb - fa, 1e-12)
        da, db = fa * (1 - fa), fb * (1 - fb)
        da[np.isinf(a)] = 0
        db[np.isinf(b)] = 0
        dz = (db - da) / p / n
        gt = np.bincount(hi, -db / p, n_grades + 1)[:k] + np.bincount(lo + 1, da / p, n_grades + 1)[1 : k + 1]
        gt /= n
        # d theta_j / d free_i = 1 or exp(free_i) for i <= j
        rest = np.cumsum(gt[::-1])[::-1]
        gf = rest * np.concatenate(([1.0], np.exp(free[1:])))
        g = np.concatenate((x.T @ dz + l2 * w, gf))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, free = w - step[: len(w)], free - step[len(w) :]
    return Model(w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rated documents; grades outside 0..K-1 are left out."""
    usable = ratings.select(F.col(id_col).cast("long").alias("__id"), F.col(grade_col).alias("grade")).where(F.col("grade").between(0, n_grades - 1))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    packed = lambda t: features_of(t).astype(np.float64).view(np.uint64)

    def fit_one(rows: list[np.ndarray], grades: np.ndarray) -> Model:
        x = np.stack([r.view(np.float64) for r in rows]) if rows else np.zeros((0, SLOTS + SHAPES))
        return fit(x, grades.astype(np.int64), n_grades)

    return fitted(sampled(texts, usable, "grade", max_rows, packed), fit_one)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: int = 1, keep_at: float = 0.5) -> DataFrame:
    """One row for each input row: ``doc_id, expected_grade, tail_probability,
    keep``.

    ``tail_probability`` is P(grade >= at_least); ``keep`` says whether it is
    ``keep_at`` or more. Null and empty texts have zero features and so a
    defined score; repeated rows score equally; other columns never matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            expected, tails = [], []
            for t in b.column(1):
                tail = model.tail(features_of(t.as_py())[None, :])[0]
                expected.append(float(tail.sum()))
                tails.append(float(tail[at_least - 1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(expected, pa.float64()), pa.array(tails, pa.float64()), pa.array([t >= keep_at for t in tails], pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probability", "keep"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")
