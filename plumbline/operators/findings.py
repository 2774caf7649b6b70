"""Advisory findings: matching, deduplication, exposure and attribution.

All frames may carry several runs; every grouping keys on ``run_id`` when the
column is there, so a fleet is one job and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import purl as P
from plumbline.functions import scalars as S

SURFACES = ("manifest", "ci", "dockerfile", "")


def run_keys(*frames: DataFrame) -> list[str]:
    return ["run_id"] if all("run_id" in f.columns for f in frames) else []


def check(matches: DataFrame, advisories: DataFrame, known_at: Column | None = None) -> DataFrame:
    """Findings: matches ``(node_id, osv_id)`` joined to advisories, as they
    were known at a time, deduplicated. A match without a record is dropped."""
    at = known_at if known_at is not None else F.lit(None).cast("timestamp")
    joined = matches.distinct().join(advisories, "osv_id").where(S.known_at(F.col("published"), F.col("withdrawn"), at))
    return dedupe(joined)


def dedupe(findings: DataFrame) -> DataFrame:
    """Per node and CVE (else id) the best record: rated before unrated, with a
    summary before without, then the smallest id. Adds ``label`` and ``cve``."""
    rated = findings.withColumns(
        {"cve": S.cve_of(F.col("osv_id"), F.col("aliases")), "label": S.severity_label(F.col("osv_id"), F.col("severity"), F.col("aliases"))}
    )
    key = [*run_keys(findings), "node_id", F.coalesce("cve", "osv_id")]
    blank = lambda c: (F.coalesce(F.col(c), F.lit("")) == "").cast("int")
    order = Window.partitionBy(*key).orderBy(blank("severity"), blank("summary"), "osv_id")
    return rated.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def action_findings(findings: DataFrame) -> DataFrame:
    """Findings on actions: matched by name only, so a weaker claim of its own type."""
    return findings.where(P.is_action("node_id")).select(
        *run_keys(findings), "node_id", P.action_name("node_id").alias("action"), P.ref_of("node_id").alias("ref"), "osv_id", "label", F.lit("name-match").alias("claim")
    )


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(S.severity_rank(F.col("label")).desc(), "node_id", "osv_id")


def surfaces(edges: DataFrame) -> DataFrame:
    """``id, surface``: where a repository's own files name a node. Edges from
    packages are transitive; a root edge to a package without a spec is where a
    lockfile placed it, not a declaration (``origin`` decides where known)."""
    placed = ~P.is_build_file("from_id") & (F.col("spec") == "") & P.is_package("to_id")
    if "origin" in edges.columns:
        placed = F.coalesce(F.col("origin") == "placement", placed)
    named = edges.where(~P.is_package("from_id") & ~placed)
    return named.select(*run_keys(edges), F.col("to_id").alias("id"), P.surface_of("from_id").alias("surface")).distinct()


def surface_sets(named: DataFrame) -> DataFrame:
    return named.groupBy(*run_keys(named), "id").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def exposure(targets: DataFrame, findings: DataFrame, named: DataFrame) -> DataFrame:
    """Per surface: versions checked, distinct versions affected, and findings
    by severity. A version named on several surfaces counts on each; one that
    none names is inherited (surface '')."""
    keys = run_keys(targets, findings, named)
    spread = lambda df, node: df.join(named.withColumnRenamed("id", node), [*keys, node], "left").withColumn("surface", F.coalesce("surface", F.lit("")))
    checked = spread(targets.select(*keys, "node_id").distinct(), "node_id").groupBy(*keys, "surface").agg(F.count(F.lit(1)).alias("checked"))
    label = F.col("label")
    hit = spread(findings.select(*keys, "node_id", "osv_id", "label"), "node_id").groupBy(*keys, "surface").agg(
        F.countDistinct("node_id").alias("affected"),
        F.count_if(label == "MALICIOUS").alias("malicious"),
        F.count_if(label == "CRITICAL").alias("critical"),
        F.count_if(label == "HIGH").alias("high"),
        F.count_if(~label.isin("MALICIOUS", "CRITICAL", "HIGH")).alias("other"),
    )
    numbers = ("checked", "affected", "malicious", "critical", "high", "other")
    return checked.join(hit, [*keys, "surface"], "full").select(
        *keys, F.when(F.col("surface") == "", "indirect").otherwise("direct").alias("reach"), "surface", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers]
    )


def severity_histogram(findings: DataFrame) -> DataFrame:
    """``label, n`` in the fixed order of severities; absent ones have no row."""
    rank = F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), F.col("label"))
    return findings.groupBy(*run_keys(findings), "label").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", rank.cast("int"))


def by_owner(findings: DataFrame, owners: DataFrame) -> DataFrame:
    """Findings per owning application, worst first; '-' owns what none does."""
    keys = run_keys(findings, owners)
    joined = findings.join(owners.select(*keys, F.col("id").alias("node_id"), "owner"), [*keys, "node_id"], "left")
    label = F.col("label")
    return (
        joined.groupBy(*keys, F.coalesce("owner", F.lit("-")).alias("owner"))
        .agg(
            F.count_if(label == "MALICIOUS").alias("malicious"),
            F.count_if(label == "CRITICAL").alias("critical"),
            F.count_if(label == "HIGH").alias("high"),
            F.count_if(~label.isin("MALICIOUS", "CRITICAL", "HIGH")).alias("other"),
        )
        .orderBy(*keys, F.desc("malicious"), F.desc("critical"), F.desc("high"), "owner")
    )


def node_owners(instances: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, owner``: lockfile folders and build files that hold a node."""
    keys = run_keys(instances, edges)
    folder = F.regexp_extract("locator", r"^([^#]*)#", 1)
    placed = instances.select(*keys, F.col("node_id").alias("id"), F.when(folder == "", ".").otherwise(folder).alias("owner"))
    built = edges.where(P.is_build_file("from_id") & F.col("from_id").contains("#")).select(*keys, F.col("to_id").alias("id"), F.regexp_extract("from_id", r"#(.*)$", 1).alias("owner"))
    return placed.union(built).distinct()


def surface_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per build file (or the pooled manifest): the names it holds, once per
    edge, and how many sit on a moving ref."""
    keys = run_keys(edges, nodes)
    named = edges.where(~P.is_package("from_id"))
    label = F.when(P.is_build_file("from_id"), F.regexp_extract("from_id", r"#(.*)$", 1)).otherwise("manifest")
    joined = named.join(nodes.select(*keys, F.col("id").alias("to_id"), "reason"), [*keys, "to_id"], "left")
    return joined.groupBy(*keys, label.alias("file")).agg(F.array_sort(F.collect_list("to_id")).alias("names"), F.count_if(F.col("reason") == "unpinned-ref").alias("moving"))


def worst_per_node(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*run_keys(findings), "node_id").agg(F.max(S.severity_rank(F.col("label"))).alias("worst"))


def cross_check(osv: DataFrame, other: DataFrame) -> DataFrame:
    """One row of counts for two sets of ``(node_id, osv_id)``: agreed, and known to one only."""
    a, b = osv.select("node_id", "osv_id").distinct().withColumn("__a", F.lit(True)), other.select("node_id", "osv_id").distinct().withColumn("__b", F.lit(True))
    return a.join(b, ["node_id", "osv_id"], "full").agg(
        F.count_if(F.col("__a") & F.col("__b")).alias("agreed"), F.count_if(F.col("__b").isNull()).alias("osv_only"), F.count_if(F.col("__a").isNull()).alias("other_only")
    )


def coverage(nodes: DataFrame) -> DataFrame:
    """``reason, n`` over nodes that were declared or opaque: the frontier."""
    return nodes.where(F.col("completeness").isin("declared", "opaque") & (F.coalesce(F.col("reason"), F.lit("")) != "")).groupBy(*run_keys(nodes), "reason").agg(F.count(F.lit(1)).alias("n"))


def auditable(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Node counts of a run and the share of them that could be audited."""
    keys = run_keys(nodes, targets)
    installed = F.coalesce(F.col("reason"), F.lit("")).isin("dev-not-installed", "extra-not-requested") == F.lit(False)
    counts = nodes.groupBy(*keys).agg(
        F.count_if(P.is_action("id")).alias("action_nodes"),
        F.count_if(P.is_action("id") & (F.col("reason") == "unpinned-ref")).alias("actions_moving"),
        F.count_if(P.is_package("id") & installed).alias("package_nodes"),
        F.count_if(P.is_package("id") & installed & (F.col("completeness") == "resolved")).alias("resolved_nodes"),
    )
    n = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"))
    joined = counts.join(n, keys, "left") if keys else counts.crossJoin(n)  # one row on either side
    surface = F.col("package_nodes") + F.col("action_nodes")
    share = F.coalesce(F.least(F.lit(1.0), F.try_divide((F.coalesce("targets", F.lit(0)) + F.col("action_nodes")).cast("double"), surface.cast("double"))), F.lit(0.0))
    return joined.withColumns({"surface": surface, "auditable": share})
