"""Package and version rollups, install state and pinning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import purl as P
from plumbline.functions.scalars import install_state, worse_rank
from plumbline.functions.versions import COMPILERS, is_exact, with_compiled
from plumbline.operators.findings import run_keys
from plumbline.operators.graph import PATH_CAP


def specs_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, spec, spec_ord`` that declare each versioned node: by its own id,
    or, only where that has none, by the version-less node of its name."""
    keys = run_keys(nodes, edges)
    declared = edges.where(F.coalesce("spec", F.lit("")) != "").select(*keys, F.col("to_id").alias("id"), "from_id", "spec")
    own = nodes.where(F.col("version") != "").select(*keys, "id", "ecosystem", "name")
    direct = own.join(declared, [*keys, "id"]).select(*keys, "id", "ecosystem", "spec", "from_id")
    bare = nodes.where(F.coalesce("version", F.lit("")) == "").select(*keys, F.col("id").alias("__bare"), "ecosystem", "name")
    named = bare.join(declared.withColumnRenamed("id", "__bare"), [*keys, "__bare"]).select(*keys, "ecosystem", "name", "spec", "from_id")
    rest = own.join(direct.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    fallback = rest.join(named, [*keys, "ecosystem", "name"]).select(*keys, "id", "ecosystem", "spec", "from_id")
    return direct.unionByName(fallback).distinct()


def version_rollup(nodes: DataFrame, edges: DataFrame, instances: DataFrame, paths: DataFrame) -> DataFrame:
    """Per package version: install state, pinning, declared spec, instances, paths.

    The three axes are never collapsed. Pinned if any spec is exact (the first
    such), else locked if installed, else floating; the declared spec shown is the
    first in (spec source, spec) order.
    """
    keys = run_keys(nodes, edges, instances, paths)
    counts = instances.groupBy(*keys, F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("instances"))
    flag = instances.groupBy(*keys).agg((F.count(F.lit(1)) > 0).alias("has"))
    specs = with_compiled(specs_of(nodes, edges))
    order = F.struct("from_id", "spec")
    exact = is_exact(F.col("compiled"))
    pins = specs.where(F.col("ecosystem").isin(*COMPILERS)).groupBy(*keys, "id").agg(
        F.bool_or(exact).alias("exact"), F.min_by("spec", F.when(exact, order)).alias("exact_spec"), F.min_by("spec", order).alias("first_spec")
    )
    rows = nodes.where((F.coalesce("version", F.lit("")) != "") & P.is_package("id"))
    rows = rows.join(counts, [*keys, "id"], "left").join(pins, [*keys, "id"], "left").join(paths, [*keys, "id"], "left")
    rows = rows.join(flag, keys, "left") if keys else rows.crossJoin(flag)  # one row
    n = F.coalesce("instances", F.lit(0))
    return rows.select(
        *keys, F.col("id").alias("node_id"), "ecosystem", "name", "version",
        install_state(n, F.coalesce("has", F.lit(False))).alias("state"),
        F.when(F.coalesce("exact", F.lit(False)), "pinned").when(n > 0, "locked").otherwise("floating").alias("pinning"),
        F.coalesce(F.when(F.col("exact"), F.col("exact_spec")), "first_spec", F.lit("")).alias("declared_spec"),
        n.cast("long").alias("instances"), F.coalesce("paths", F.lit(0)).cast("int").alias("paths"),
    )


def package_rollup(nodes: DataFrame, edges: DataFrame, versions: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Per package: any root edge, instances, saturating paths, worst
    completeness, versions. ``roots``: ``id`` (with run_id)."""
    keys = run_keys(nodes, edges, versions, paths, roots)
    top = edges.join(roots.select(*keys, F.col("id").alias("from_id")), [*keys, "from_id"], "left_semi").select(*keys, F.col("to_id").alias("id")).distinct().withColumn("d", F.lit(True))
    rows = nodes.join(roots.select(*keys, "id"), [*keys, "id"], "left_anti").join(top, [*keys, "id"], "left").join(paths, [*keys, "id"], "left")
    rows = rows.join(versions.select(*keys, F.col("node_id").alias("id"), "instances", F.col("version").alias("v")), [*keys, "id"], "left")
    counted = F.when(P.is_package("id") | (F.coalesce(F.col("version"), F.lit("")) == ""), F.coalesce("paths", F.lit(0))).otherwise(0)
    return rows.groupBy(*keys, "ecosystem", "name").agg(
        F.coalesce(F.bool_or("d"), F.lit(False)).alias("direct"),
        F.coalesce(F.sum("instances"), F.lit(0)).cast("long").alias("instance_count"),
        F.least(F.sum(counted), F.lit(PATH_CAP)).cast("int").alias("path_count"),
        F.max_by("completeness", worse_rank(F.col("completeness"))).alias("worst_completeness"),
        F.array_sort(F.collect_set("v")).alias("versions"),
    )


def pinning_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy(*run_keys(versions), "pinning").agg(F.count(F.lit(1)).alias("n"))


def pins(instances: DataFrame) -> DataFrame:
    """``ecosystem, name, version`` where a lockfile holds exactly one version."""
    keys = run_keys(instances)
    parts = instances.select(*keys, P.purl_type("node_id").alias("ecosystem"), P.purl_name("node_id").alias("name"), P.purl_version("node_id").alias("version"))
    return parts.groupBy(*keys, "ecosystem", "name").agg(F.min("version").alias("version"), F.max("version").alias("__max")).where("version = __max").drop("__max")


def merge_instances(instances: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and spec-less placement edges of lockfile instances: from the
    parent instance's node, else from the root."""
    keys = run_keys(instances, roots)
    nodes = instances.select(
        *keys, F.col("node_id").alias("id"), P.purl_type("node_id").alias("ecosystem"), P.purl_name("node_id").alias("name"),
        P.purl_version("node_id").alias("version"), F.lit("resolved").alias("completeness"),
    ).distinct()
    parents = instances.select(*keys, F.col("locator").alias("parent_locator"), F.col("node_id").alias("__parent"))
    root = roots.select(*keys, F.col("id").alias("__root"))
    joined = instances.join(parents, [*keys, "parent_locator"], "left")
    joined = joined.join(root, keys) if keys else joined.crossJoin(root)  # one row
    edges = joined.select(
        *keys, F.coalesce("__parent", "__root").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("depends_on").alias("kind"),
        F.lit("").alias("spec"), F.lit("prod").alias("scope"), F.lit("placement").alias("origin"),
    ).distinct()
    return nodes, edges
