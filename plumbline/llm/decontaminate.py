"""Benchmark decontamination as a prefix-filtered set join (operator 7).

DataFrame functions only. An item's windows are its runs of 13 words (an item
of fewer words is one window); a window is the set of its 5-word shingles with
their offsets. Steps:

1. One scan of the documents hashes the shingle at every position and keeps
   the positions whose shingle is in the benchmark (the hits).
2. The hits give every benchmark shingle's frequency over the whole corpus.
   Shingles are ordered by rarity; containment is exact, so the necessary
   prefix of a window is its one rarest shingle.
3. Hits on prefixes propose (document, start, window); the positional bound
   ``0 <= start`` and the length bound ``start + length <= n_words`` apply.
4. Proposed documents are read again and each window is compared word by word.
5. The covered positions are summed as a union of intervals.

Hashes only propose: what is returned has been compared as text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checked, free_names, materialise, row_key

WINDOW = 13
SHINGLE = 5

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def exact_words(text: Column) -> Column:
    """Words after lower-casing A-Z alone, in order; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _GAPS), "")


def _folded_words(text: Column) -> Column:
    """The same words up to case, cheaper; equal exact words stay equal.

    Lower-casing never turns a word character into a gap or back, so words keep
    their places. The final sigma is the one letter whose lower case depends
    on what follows.
    """
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))
    return F.array_remove(F.split(lowered, _GAPS), "")


def _windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``item_id, window (words), folded, n`` for each distinct window."""
    words = items.select(
        F.col(item_col).cast("string").alias("item_id"), exact_words(F.col(text_col)).alias("w"), _folded_words(F.col(text_col)).alias("f")
    ).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return (
        words.withColumn("n", n)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
        .select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("window"), F.slice("f", F.col("at"), F.col("n")).alias("folded"), "n")
        .distinct()
    )


def _shingle_hashes(words: Column, n: int) -> Column:
    """Hash of the ``n`` words at each position, in order; empty if there are fewer."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``.

    A document is contaminated if at least one word in twenty is hit. Null and
    empty texts have no words and are clean; items without words have no
    windows; repeated rows give repeated results; items that share a window
    all count; null item ids mark words as hit but name no item. Empty tables
    on either side leave every document clean. Other columns are ignored.
    """
    spans = materialise(_windows(items, item_col, item_text_col, window).withColumn("window_id", F.xxhash64("window")))
    shapes = spans.select("window_id", "window", "folded", "n").dropDuplicates(["window_id", "window"])
    tokens = materialise(
        shapes.withColumn("size", F.least("n", F.lit(shingle))).select(
            "window_id",
            "n",
            "size",
            F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.xxhash64(F.slice("folded", i, F.col("size"))))).alias("offset", "shingle"),
        )
    )
    # lengths of shingles in the benchmark: at most ``shingle`` of them
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())

    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = words.select("doc_id", row_key("doc_id", "text").alias("key"), _folded_words(F.col("text")).alias("f"))
    # one pass for all lengths; its first row of a document has the number of words
    mark = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.size("f").cast("long").alias("value")))
    numbered = lambda size: F.transform(_shingle_hashes(F.col("f"), size), lambda v, i: F.struct(F.lit(size).alias("size"), (i + 1).alias("at"), v.alias("value")))
    if len(sizes) == 1:
        spread = words.select("doc_id", "key", F.posexplode(F.concat(F.array(F.size("f").cast("long")), _shingle_hashes(F.col("f"), sizes[0]))).alias("at", "value"))
        spread = spread.withColumn("size", F.when(F.col("at") > 0, sizes[0]).otherwise(0))
    else:
        spread = words.select("doc_id", "key", F.inline(F.concat(mark, *[numbered(size) for size in sizes])))
    known = checked(materialise(tokens.select("size", F.col("shingle").alias("value")).distinct().withColumn("known", F.lit(True))))
    if len(sizes) == 1:
        spread = spread.join(known.drop("size"), "value", "left").where("at = 0 OR known")
    else:
        spread = spread.join(known, ["size", "value"], "left").where("at = 0 OR known")
    found = materialise(spread.select("doc_id", "key", "size", "at", "value"))

    base = found.where("at = 0").select("doc_id", "key", F.col("value").alias("n_words"))
    hits = found.where("at > 0")
    frequency = hits.groupBy("size", F.col("value").alias("shingle")).agg(F.count(F.lit(1)).alias("df"))
    prefixes = (
        tokens.join(frequency, ["size", "shingle"], "left")
        .groupBy("window_id", "n", "size")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("rare"))
        .where("rare.df > 0")  # a window with a shingle that occurs nowhere occurs nowhere
        .select("window_id", "n", "size", "rare.shingle", "rare.offset")
    )
    proposed = _propose(hits, prefixes)
    keys = materialise(proposed.select("key").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", row_key("doc_id", "text")).join(checked(keys), "key", "left_semi")
    texts = texts.dropDuplicates(["key"]).select("key", exact_words(F.col("text")).alias("w"))
    # a window id stands for its words: compare them, and only them
    matched = (
        proposed.join(texts, "key")
        .where(F.col("start") + F.col("n") <= F.size("w"))
        .select("key", "start", "n", "window_id", F.slice("w", F.col("start") + 1, F.col("n")).alias("window"))
        .join(spans.select("window_id", "window", "item_id"), ["window_id", "window"])
        .select("key", "start", "n", "item_id")
        .distinct()
    )
    matched = materialise(matched)

    covered = matched.select("key", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    covered.createOrReplaceTempView("__plumbline_covered")
    hit = docs.sparkSession.sql(
        """
        SELECT key, sum(greatest(0, end - greatest(start, before))) AS n_hit FROM (
          SELECT *, coalesce(max(end) OVER (PARTITION BY key ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM __plumbline_covered)
        GROUP BY key
        """
    )
    named = matched.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = base.join(hit, "key", "left").join(named, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _propose(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    rare = materialise(prefixes.select("window_id", "n", F.col("size").alias("of_size"), "shingle", "offset"))
    joined = hits.join(checked(rare), (F.col("size") == F.col("of_size")) & (F.col("value") == F.col("shingle")))
    return materialise(
        joined.select("key", (F.col("at") - 1 - F.col("offset")).alias("start"), "window_id", "n").where("start >= 0").distinct()
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns. Rows are told
    apart by id and text: a null or repeated id takes no other row with it."""
    key, bad_key = free_names(docs, "__key", "__bad_key")
    own = row_key("doc_id", "text")
    bad = contamination(docs.select(own.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias(bad_key)).distinct()
    return docs.withColumn(key, own).join(checked(materialise(bad)), F.col(key) == F.col(bad_key), "left_anti").drop(key)


#: The same result in DuckDB SQL.
ORACLE = r"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p0 : p0 + n - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p0 FROM (SELECT *, least(len(w), 13) AS n FROM it WHERE len(w) > 0))),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
pos AS (
  SELECT doc_id, n, p0, array_to_string(w[p0 : p0 + n - 1], ' ') AS win
  FROM (SELECT d.doc_id, d.w, s.n, unnest(generate_series(1, len(d.w) - s.n + 1)) AS p0 FROM d, (SELECT DISTINCT n FROM win) s)),
m AS (SELECT pos.doc_id, pos.p0, pos.n, win.item_id FROM pos JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p0, p0 + n - 1)) AS p FROM (SELECT DISTINCT doc_id, p0, n FROM m)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
