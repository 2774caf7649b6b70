"""Requirements against registry versions: satisfy, filter by time, enumerate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.versions import satisfies, version_columns, with_compiled
from plumbline.operators.workspace import by_key

MOST_VERSIONS = 25


def parsed_versions(registry: DataFrame) -> DataFrame:
    """Adds ``parsed`` to ``ecosystem, name, version, published_at``; what is not a
    version of its scheme goes."""
    return registry.withColumn("parsed", version_columns(F.col("ecosystem"), F.col("version"))).where("parsed IS NOT NULL")


def as_of(registry: DataFrame, at: Column | datetime | None) -> DataFrame:
    """Versions published by a time, or at an unknown time. Adds ``undated``:
    a package none of whose versions has a time cannot be resolved as of one."""
    if at is None:
        return registry.withColumn("undated", F.lit(False))
    at = F.lit(at) if isinstance(at, datetime) else at
    dated = Window.partitionBy("ecosystem", "name")
    rows = registry.withColumn("undated", ~F.bool_or(F.col("published_at").isNotNull()).over(dated))
    return rows.where(F.col("published_at").isNull() | (F.col("published_at") <= at))


def enumerate_versions(requirements: DataFrame, registry: DataFrame, mode: str = "will", most: int = MOST_VERSIONS) -> DataFrame:
    """Versions each requirement allows, newest first, with ``place`` from 1.

    ``requirements``: ``ecosystem, name, spec`` (and more). ``mode`` is ``will``
    (what an install picks: the newest; the bound itself for Go) or ``can`` (all,
    at most ``most`` per range). PyPI leaves pre-releases out unless the spec
    mentions one or nothing else is left. Distinct (package, spec) pairs are
    enumerated once and joined back.
    """
    if mode not in ("will", "can"):
        raise ValueError(f"mode: {mode}")
    asks = with_compiled(requirements.select("ecosystem", "name", "spec").distinct())
    met = asks.join(by_key(parsed_versions(registry)), ["ecosystem", "name"]).where(satisfies(F.col("parsed"), F.col("compiled")))
    req = ["ecosystem", "name", "spec"]
    if mode == "will":
        # the newest of each, by partial aggregation: no range's versions meet in a window
        newest = F.struct("parsed.key", "version")
        best = met.where("ecosystem <> 'golang'").groupBy(*req).agg(
            F.max(newest).alias("any"), F.max(F.when(~F.col("parsed.is_pre"), newest)).alias("stable"), F.bool_or("compiled.mentions_pre").alias("pre")
        )
        chosen = F.when((F.col("ecosystem") == "pypi") & ~F.col("pre"), F.coalesce("stable", "any")).otherwise(F.col("any"))
        picked = best.select(*req, chosen.getField("version").alias("version"), F.lit(1).alias("place"))
        # a Go requirement is its own lower bound, listed or not
        own = asks.where("ecosystem = 'golang' AND compiled.ok").select(*req, version_columns(F.lit("golang"), F.regexp_replace("spec", r"^\s*>=?\s*", "")).getField("canonical").alias("version"), F.lit(1).alias("place"))
        return requirements.join(by_key(picked.unionByName(own)), req)
    stable = F.bool_or(~F.col("parsed.is_pre")).over(Window.partitionBy(*req))
    met = met.withColumn("__stable", stable)
    met = met.where((F.col("ecosystem") != "pypi") | F.col("compiled.mentions_pre") | ~F.col("__stable") | ~F.col("parsed.is_pre"))
    rank = F.row_number().over(Window.partitionBy(*req).orderBy(F.desc("parsed.key"), F.desc("version")))
    met = met.withColumn("place", rank).where(F.col("place") <= most)
    picked = met.select(*req, F.when(F.col("ecosystem") == "golang", F.col("parsed.canonical")).otherwise(F.col("version")).alias("version"), "place")
    return requirements.join(by_key(picked), req)


def apply_pins(requirements: DataFrame, picked: DataFrame, pins: DataFrame, registry: DataFrame) -> DataFrame:
    """Where a lockfile pins a package to one version it overrides what would be
    picked; a pin the registry does not list stays, with a reason."""
    keyed = pins.select("ecosystem", "name", F.col("version").alias("__pin"))
    listed = registry.select("ecosystem", "name", F.col("version").alias("__pin")).distinct().withColumn("__listed", F.lit(True))
    pinned = requirements.join(by_key(keyed), ["ecosystem", "name"]).join(by_key(listed), ["ecosystem", "name", "__pin"], "left")
    over = pinned.withColumns({"version": F.col("__pin"), "place": F.lit(1), "reason": F.when(F.col("__listed").isNull(), "error:pin-not-found")}).drop("__pin", "__listed")
    rest = picked.join(by_key(keyed.select("ecosystem", "name")), ["ecosystem", "name"], "left_anti").withColumn("reason", F.lit(None).cast("string"))
    return over.unionByName(rest)
