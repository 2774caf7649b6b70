"""Toxicity by a factorization machine over hashed terms (operator 10).

A document is the set of its terms: hashed words, and hashed 4-byte word
beginnings, so that inflected or compounded insults share a term. The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms present: the
factors ``v`` give every pair of terms a learned interaction, which an additive
model has no weight for.

The fit uses a bounded sample of the labelled rows (``max_rows``, the rows with
the smallest hashes of their ids, texts up to ``MAX_BYTES``), selects at most
``max_terms`` terms that tell about the label, alone or in pairs, and trains on
one executor with AdaGrad. The model is a few
hundred KB whatever the corpus, and goes to the workers with the function.
Scoring reads each whole text once and shuffles nothing.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hash_sample
from plumbline.llm.terms import words_of

PREFIX = 4
MAX_ROWS = 8_000
MAX_TERMS = 8_192
THRESHOLD = 0.3
#: Longer texts are scored like all others, but not fitted on.
MAX_BYTES = 200_000
_SAMPLED = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int64()))])
#: Most frequent terms among which pairs are looked for.
PAIR_TERMS = 512


def terms_of(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text, sorted."""
    return np.unique(np.concatenate(words_of(text, (PREFIX,))))


@dataclass
class Model:
    terms: np.ndarray  # sorted uint64
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, present: np.ndarray) -> float:
        at = np.searchsorted(self.terms, present)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == present] if len(self.terms) else at[:0]
        if not len(at):
            return self.w0
        v = self.v[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.w0 + float(self.w[at].sum()) + pairs

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(terms_of(text)), -40, 40))))


def _informative(rows: list[np.ndarray], labels: np.ndarray, most: int, least_rows: int, strictness: float = 0.8) -> np.ndarray:
    """The terms with the largest likelihood-ratio statistic against the label,
    if it stands out among so many terms: ``strictness`` times the logarithm of
    their number."""
    terms, df = np.unique(np.concatenate(rows), return_counts=True)
    found, n_found = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y]), return_counts=True)
    pos = np.zeros(len(terms))
    pos[np.searchsorted(terms, found)] = n_found
    n, n1 = len(labels), labels.sum()

    def part(observed, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed / expected), 0.0)

    g = part(pos, df * n1 / n) + part(df - pos, df * (n - n1) / n) + part(n1 - pos, (n - df) * n1 / n) + part(n - df - n1 + pos, (n - df) * (n - n1) / n)
    g[df < least_rows] = 0
    order = np.lexsort((terms, -g))[:most]
    return np.sort(terms[order[g[order] > max(2.0, strictness * np.log(max(1, len(terms))))]])


def _paired(rows: list[np.ndarray], labels: np.ndarray, least_rows: int, strictness: float = 2.0) -> np.ndarray:
    """Terms that tell about the label in pairs: of the ``PAIR_TERMS`` most frequent
    ones those in a pair whose four combinations have a likelihood-ratio statistic
    that exceeds what either term has alone by ``strictness`` times the logarithm of
    the number of pairs."""
    terms, df = np.unique(np.concatenate(rows), return_counts=True)
    n, least = len(labels), max(least_rows, 20)
    usual = np.flatnonzero((df >= least) & (df <= n - least))
    usual = np.sort(usual[np.lexsort((terms[usual], -df[usual]))][:PAIR_TERMS])
    if len(usual) < 2:
        return np.empty(0, np.uint64)
    chosen = terms[usual]
    x = np.stack([np.isin(chosen, r, assume_unique=True) for r in rows]).astype(np.float32)
    y = labels.astype(np.float32)
    every, toxic = (x.T @ x).astype(np.float64), ((x * y[:, None]).T @ x).astype(np.float64)

    def cells(both: np.ndarray, total: float) -> list[np.ndarray]:
        one = np.diag(both)
        return [both, one[:, None] - both, one[None, :] - both, total - one[:, None] - one[None, :] + both]

    def term(observed: np.ndarray, out_of: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed / out_of), 0.0)

    def fitted(bad: list[np.ndarray], of: list[np.ndarray]) -> np.ndarray:
        return sum(term(b, o) + term(o - b, o) for b, o in zip(bad, of))

    joint = fitted(cells(toxic, float(y.sum())), cells(every, float(n)))
    one, bad = np.diag(every), np.diag(toxic)
    alone = fitted([bad, y.sum() - bad], [one, n - one])
    base = float(term(np.array(float(y.sum())), np.array(float(n))) + term(np.array(n - float(y.sum())), np.array(float(n))))
    gain = joint - base - (alone[:, None] - base) - (alone[None, :] - base)
    np.fill_diagonal(gain, 0)
    return chosen[(gain > strictness * np.log(len(chosen) ** 2 / 2)).any(axis=1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 30, max_terms: int = MAX_TERMS, least_rows: int = 4, l2: float = 5e-5, seed: int = 7) -> Model:
    """Factorization machine on distinct terms per row; deterministic."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        p = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4))
        return Model(np.empty(0, np.uint64), float(np.log(p / (1 - p))), np.empty(0), np.empty((0, rank)))
    paired = _paired(rows, labels, least_rows)[:max_terms]
    terms = np.union1d(_informative(rows, labels, max_terms - len(paired), least_rows), paired)
    index = [np.flatnonzero(np.isin(terms, r, assume_unique=True)) for r in rows]
    rng = np.random.default_rng(seed)
    p = labels.mean()
    w0, w, v = float(np.log(p / (1 - p))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), rank))
    g0, gw, gv = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), rank), 1e-6)
    for epoch in range(epochs):
        rate = 0.15 / (1 + 0.1 * epoch)
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            sizes = np.array([len(index[i]) for i in batch])
            at = np.concatenate([index[i] for i in batch]) if sizes.sum() else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(batch)), sizes)
            va = v[at]
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, row, va)
            squares = np.bincount(row, (va**2).sum(axis=1), len(batch))
            logit = w0 + np.bincount(row, w[at], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            err = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[batch]
            g0 += err.sum() ** 2
            w0 -= rate * err.sum() / np.sqrt(g0)
            dw = np.bincount(at, err[row], len(w))
            dv = np.zeros_like(v)
            np.add.at(dv, at, err[row, None] * (sums[row] - va))
            used = np.unique(at)
            dw, dv = dw[used] + l2 * len(batch) * w[used], dv[used] + l2 * len(batch) * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Model(terms, w0, w, v)


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, extract=terms_of) -> DataFrame:
    """``id, label, terms`` of at most ``max_rows`` labelled documents.

    ``labels`` has ``__id`` and the label. Taken by hash of the id, so the
    sample does not depend on partitioning. Ids with different labels, null labels
    and texts beyond ``MAX_BYTES`` are left out; of different texts under one id
    the one with the smallest hash is taken.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("__id").isNotNull())
    known = known.groupBy("__id").agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most")).where("__label = __most")
    chosen = hash_sample(known, max_rows, "__id").select("__id", F.col("__label").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(t.as_py()).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "label", "terms"])

    joined = docs.where(F.octet_length(F.coalesce("__text", F.lit(""))) <= MAX_BYTES).join(F.broadcast(chosen), "__id")
    one = joined.groupBy("__id", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    return one.select("__id", "__label", "__text").mapInArrow(run, "id long, label int, terms array<long>")


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    if not table.num_rows:
        return [], np.empty(0, np.int32)
    table = table.sort_by("id").combine_chunks()
    terms = table.column("terms").combine_chunks()
    values, ends = terms.values.to_numpy().view(np.uint64), terms.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])], table.column("label").to_numpy()


def sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, extract=terms_of) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of sampled(), on the driver."""
    return _arrays(sampled(docs, labels, label_col, max_rows, extract).toArrow())


def fitted(rows: DataFrame, fit_one):
    """``fit_one(terms, labels)`` of the rows of sampled(), run as one task of an
    executor, so that the driver only gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(fit_one(*_arrays(pa.Table.from_batches(list(batches), _SAMPLED))))
        # workers live on, so what the fit took goes back to the system
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not on every system
            ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").first()["model"])


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).alias(label_col)).where(F.col(label_col).isin(0, 1) & ~held_out("__id"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return fitted(sampled(texts, usable, label_col, max_rows), fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts have no terms and get the base rate; repeated rows get
    equal scores; a null id is not held out. Other columns never matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    model = train(docs, labels)

    def score_all(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    scored = F.arrow_udf(score_all, "double")

    return docs.where(scored(F.col("text").cast("string")) < threshold)
