"""Cross-entropy difference scoring with matched n-gram models (operator 8).

A target model (documents marked good) and a background model (all documents)
have the same order, smoothing and vocabulary: UTF-8 bytes of the lower-cased
text after a start mark. A token is a byte; an n-gram is ``ORDER`` bytes packed
into one long, so counts are exact and have no collisions. With
``p(b | context) = (count + A) / (context count + 256 A)`` in either model, a
document's score is the mean over its bytes of ``log p_target - log
p_background``: above zero it reads more like the target. A document's own
occurrences are taken out of both models before it is scored, so that no
document is judged by itself; other copies of it stay in.

Counting runs over every document: each batch is counted in sorted arrays and
shuffled as partial counts, merged by n-gram. Scoring sends each worker the
counts while their number was found to be small (``TABLE_ROWS``); beyond that
documents send their n-gram counts to the table instead, with the same sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checked, materialise

ORDER = 5
SMOOTHING = 0.05
#: The counts go to the workers up to this many rows (24 bytes each).
TABLE_ROWS = 3_000_000


def ngrams(text: str | None, order: int = ORDER) -> np.ndarray:
    """Packed n-grams, one for each byte of the lower-cased text, in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    padded = np.concatenate((np.zeros(order - 1, np.int64), raw.astype(np.int64)))
    out = np.zeros(len(raw), np.int64)
    for k in range(order):
        out = (out << 8) | padded[k : k + len(raw)]
    return out


def counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``gram, n_target, n_background`` over all documents.

    ``target``: ``__id`` of the target documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(1).to_pylist()
            # bounded buffers: a slice of the batch at a time
            parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
            size, n = 0, b.num_rows
            for i in range(n):
                g = ngrams(b.column(0)[i].as_py(), order)
                parts[bool(marks[i])].append(g)
                size += len(g)
                if size < 4_000_000 and i < n - 1:
                    continue
                good = np.concatenate(parts[True]) if parts[True] else np.empty(0, np.int64)
                rest = np.concatenate(parts[False]) if parts[False] else np.empty(0, np.int64)
                if size:
                    keys, inverse = np.unique(np.concatenate((good, rest)), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.bincount(inverse[: len(good)], minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(keys)).astype(np.int64))],
                        names=["gram", "n_target", "n_background"],
                    )
                parts, size = {True: [], False: []}, 0

    # texts stay where they are while the ids of the target are few
    return _marked(docs, target, id_col, text_col).select("text", "good").mapInArrow(run, "gram long, n_target long, n_background long").groupBy("gram").agg(F.sum("n_target").alias("n_target"), F.sum("n_background").alias("n_background"))


def _marked(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, good`` for each row; ``good`` is null outside the target."""
    good = target.select(F.col("__id"), F.lit(True).alias("good")).where(F.col("__id").isNotNull()).dropDuplicates(["__id"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(checked(materialise(good)), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "good")


def _mean_difference(n: np.ndarray, own: np.ndarray, good: bool, target: np.ndarray, target_context: np.ndarray, background: np.ndarray, background_context: np.ndarray, smoothing: float) -> float:
    """Of a document with ``n`` occurrences of each n-gram and ``own`` of its context."""
    n, own = n.astype(np.float64), own.astype(np.float64)
    p = (target - n * good + smoothing) / (target_context - own * good + 256 * smoothing)
    q = (background - n + smoothing) / (background_context - own + 256 * smoothing)
    return math.fsum((np.log(p) - np.log(q)) * n) / float(n.sum())


def _of_context(grams: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """For sorted n-grams: the sums of ``values`` over each one's context."""
    context = grams >> 8
    starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(grams)])))
    return [np.repeat(np.add.reduceat(v, starts), sizes) for v in values]


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, table_rows: int = TABLE_ROWS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row for each input row: ``doc_id, n_tokens, score``.

    Null and empty texts have no tokens and score 0.0. Without target
    documents the target model is uniform; repeated rows score equally, and
    every repetition counts in the background. Other columns are ignored.
    """
    table = materialise(counts(docs, target, id_col, text_col, order))
    rows = _marked(docs, target, id_col, text_col)
    if table.limit(table_rows + 1).count() > table_rows:
        return _score_by_join(rows, table, order, smoothing)
    got = table.toArrow()
    grams = got.column("gram").to_numpy()
    by = np.argsort(grams)
    held = docs.sparkSession.sparkContext.broadcast((grams[by], got.column("n_target").to_numpy()[by], got.column("n_background").to_numpy()[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, t, b = held.value
        tc, bc = _of_context(keys, t, b) if len(keys) else (t, b)
        for batch in batches:
            sizes, scores = [], []
            for text, good in zip(batch.column(1), batch.column(2)):
                g = ngrams(text.as_py(), order)
                sizes.append(len(g))
                if not len(g):
                    scores.append(0.0)
                    continue
                own, n = np.unique(g, return_counts=True)
                at = np.searchsorted(keys, own)
                scores.append(_mean_difference(n, _of_context(own, n)[0], good.is_valid, t[at], tc[at], b[at], bc[at], smoothing))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")


def _score_by_join(rows: DataFrame, table: DataFrame, order: int, smoothing: float) -> DataFrame:
    """The same scores with the table left where it is. Frequent n-grams are
    frequent keys of a plain join, whose large partitions the planner can split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g = ngrams(b.column(3)[i].as_py(), order)
                own, n = np.unique(g, return_counts=True)
                if not len(own):
                    continue
                same = [pa.array(np.full(len(own), b.column(c)[i].as_py())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(own), pa.array(n.astype(np.int64)), pa.array(_of_context(own, n)[0].astype(np.int64))], names=["k1", "k2", "k3", "gram", "n", "own"])

    context = F.shiftright("gram", 8)
    totals = table.groupBy(context.alias("c")).agg(F.sum("n_target").alias("tc"), F.sum("n_background").alias("bc"))
    models = table.join(totals, context == F.col("c")).select("gram", F.col("n_target").alias("t"), F.col("n_background").alias("b"), "tc", "bc")
    # rows are told apart by 128 bits of their content; repeated rows get their own result back
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), F.when(F.col("good"), 1).otherwise(0).cast("long").alias("k3")]
    keyed = materialise(rows.select("doc_id", "text", *keys))
    spread = keyed.select("k1", "k2", "k3", "text").dropDuplicates(["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, k3 long, gram long, n long, own long")
    p = (F.col("t") - F.col("n") * F.col("k3") + smoothing) / (F.col("tc") - F.col("own") * F.col("k3") + 256 * smoothing)
    q = (F.col("b") - F.col("n") + smoothing) / (F.col("bc") - F.col("own") + 256 * smoothing)
    summed = spread.join(models, "gram").groupBy("k1", "k2").agg(F.sum("n").alias("n_tokens"), F.sum((F.log(p) - F.log(q)) * F.col("n")).alias("s"))
    out = keyed.select("doc_id", "k1", "k2").join(summed, ["k1", "k2"], "left")
    return out.select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce(F.col("s") / F.col("n_tokens"), F.lit(0.0)).alias("score"))
