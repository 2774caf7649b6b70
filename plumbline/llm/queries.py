"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, decontaminate, line_dedup, lm_score, packing, preference, quality, simhash_dedup, token_counts, toxicity
from plumbline.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_table(table(spark, sf_dir, "documents"), token_counts.public_tokenizer(), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_chars")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grades from the two labels: poor; sound but toxic; sound. None where a
    label that decides is null."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
    return quality.score(docs, quality.train(docs, ratings, n_grades=3))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.clean_vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_table(table(spark, sf_dir, "documents"), token_counts.public_tokenizer(), max_len=packing.MAX_LEN)
    return packing.pack(counted, "doc_id", F.col("n_tokens"), F.col("ends"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.with_stale_answers(table(spark, sf_dir, "conversations")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").cast("long").alias("__id"))
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quality": op3_quality,
    "op4_ann": op4_ann,
    "op5_packing": op5_packing,
    "op6_preference": op6_preference,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB SQL where SQL can express the query.
ORACLE: dict[str, str] = {"op6_preference": preference.ORACLE, "op7_decontaminate": decontaminate.ORACLE}
