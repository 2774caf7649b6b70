"""Packing by optimal length buckets (operator 5).

Lengths of a whole corpus have a small histogram: sequences longer than
``max_len`` are cut into pieces of ``max_len`` and a rest, so it has at most
``max_len + 1`` entries. A dynamic program over it chooses the bucket
boundaries that minimise padding exactly: with ``L`` the sorted lengths,
``best[k][j] = min_i best[k-1][i] + pad(i+1..j)``, where every sequence of a
bucket is padded to its longest.

Inside a bucket of padded length ``b`` batches of ``budget // b`` sequences
form from consecutive ranks. Ranks are global without any global sort: rows
are dealt by hash into slots of about ``SLOT_ROWS``, counted per slot, and a
slot's ranks start where the slots before it end. Only ids and lengths are
shuffled; no bucket is ever in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import materialise

MAX_LEN = 8_192
BUDGET = 65_536
BUCKETS = 8
#: Rows that a slot holds about, whatever the size of the corpus.
SLOT_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; zero for null. A length without a tokenizer."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least padding.

    ``lengths`` increase. Exact; among optima the one whose last buckets start
    earliest. Quadratic in distinct lengths with vectorised rows.
    """
    m = len(lengths)
    if m == 0:
        return []
    x, c = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    n, s = np.concatenate(([0.0], np.cumsum(c))), np.concatenate(([0.0], np.cumsum(c * x)))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, m)):
        now, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + x[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            at[j] = int(np.argmin(cost))
            now[j] = cost[at[j]]
        choice.append(at)
        best = now
    ends, j = [], m
    for at in reversed(choice):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(at[j])
    return ends[::-1]


def pieces(rows: DataFrame, id_col: str, length: Column, ends: Column | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """``doc_id, piece, n_tokens, start_byte, end_byte``: sequences of at most
    ``max_len`` tokens. ``ends`` has the byte at which each piece ends."""
    base = rows.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("__n"), (F.lit(None) if ends is None else ends).cast("array<long>").alias("__ends"))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / max_len))
    piece = base.select("doc_id", "__n", "__ends", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at")).withColumn("piece", F.col("at").cast("int"))
    start = F.when(F.col("piece") == 0, F.when(F.col("__ends").isNotNull(), F.lit(0).cast("long"))).otherwise(F.get("__ends", F.col("piece") - 1))
    return piece.select("doc_id", "piece", F.least(F.lit(max_len).cast("long"), F.col("__n") - F.col("at") * max_len).alias("n_tokens"), start.alias("start_byte"), F.get("__ends", F.col("piece")).alias("end_byte"))


def pack(rows: DataFrame, id_col: str, length: Column, ends: Column | None = None, max_len: int = MAX_LEN, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row for each piece: ``doc_id, piece, n_tokens, start_byte, end_byte,
    bucket, padded_length, batch_id, slot``.

    Bytes ``start_byte`` to ``end_byte`` of the UTF-8 text are the piece, and a
    document's pieces in order are its whole text; null without ``ends``. A
    batch holds at most ``budget`` tokens padded, or one piece if a single
    piece is longer. Empty texts are pieces of length zero and are padded like
    the rest of their bucket. Repeated rows are packed each. An empty table gives
    no rows. Deterministic up to the order of identical rows.
    """
    spark = rows.sparkSession
    cut = materialise(pieces(rows, id_col, length, ends, max_len))
    # at most max_len + 1 rows, whatever the corpus
    histogram = sorted((r["n_tokens"], r["n"]) for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    total = sum(n for _, n in histogram)
    slots = max(1, -(-total // SLOT_ROWS))
    table = spark.createDataFrame(
        [(i, e, max(1, budget // max(1, e))) for i, e in enumerate(ends)],
        T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("padded_length", T.LongType()), T.StructField("per_batch", T.LongType())]),
    )
    bucket = F.lit(len(ends)).cast("int")
    for i in reversed(range(len(ends))):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    dealt = cut.withColumn("bucket", bucket).withColumn("__h", F.xxhash64("doc_id", "piece", "n_tokens", "end_byte"))
    dealt = dealt.withColumn("__slot", F.pmod(F.col("__h"), F.lit(slots)).cast("int"))
    counts = dealt.groupBy("bucket", "__slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", "__slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("bucket", "__slot").orderBy("__h", "doc_id", "piece", "n_tokens", "end_byte")
    ranked = dealt.withColumn("__rank", F.row_number().over(own) - 1).join(starts, ["bucket", "__slot"]).join(F.broadcast(table), "bucket")
    place = F.col("__start") + F.col("__rank")
    return ranked.select(
        "doc_id",
        "piece",
        "n_tokens",
        "start_byte",
        "end_byte",
        "bucket",
        "padded_length",
        F.concat_ws("-", F.col("bucket"), F.floor(place / F.col("per_batch"))).alias("batch_id"),
        F.pmod(place, F.col("per_batch")).alias("slot"),
    )
