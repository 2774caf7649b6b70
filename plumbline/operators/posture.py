"""Upstream posture: facts and scorecards to named signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.findings import run_keys

#: Check, score at or below which it signals, signal, meaning.
SCORECARD_RULES = (
    ("Maintained", 0, "unmaintained", "no commit or issue activity in the last 90 days, or the repo is archived"),
    ("Dangerous-Workflow", 0, "dangerous-workflow", "CI workflow has an untrusted-input injection or untrusted checkout pattern"),
    ("Code-Review", 0, "unreviewed-code", "changes merge without review; one compromised maintainer account is sufficient"),
    ("Branch-Protection", 0, "no-branch-protection", "release branch accepts force-push and unreviewed direct commits"),
    ("Token-Permissions", 0, "overprivileged-ci", "CI grants write-all tokens to workflow steps"),
    ("Pinned-Dependencies", 2, "unpinned-upstream-build", "the project's own build pulls floating dependencies"),
    ("Signed-Releases", 0, "unsigned-releases", "releases are published without signatures"),
)
#: Signals in the order reports list them.
SIGNAL_ORDER = (
    "deprecated", "unlisted", "unmaintained", "dangerous-workflow", "unreviewed-code", "no-branch-protection", "overprivileged-ci",
    "no-source-repo", "unsigned-releases", "unpinned-upstream-build", "no-license", "non-standard-license", "unattested-source", "no-scorecard",
)
#: Signals so common that reports keep them apart.
BASELINE = ("unattested-source", "no-scorecard", "unpinned-upstream-build", "unsigned-releases", "non-standard-license")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCORECARD_RULES, "check string, at_or_below int, code string, detail string")


def scorecard_signals(projects: DataFrame) -> DataFrame:
    """``source_repo, code, detail, reason, evidence`` from the check maps; a
    score of -1 means the check did not run and signals nothing."""
    checks = projects.where("has_scorecard").select(F.col("project_id").alias("source_repo"), F.explode("checks").alias("check", "c"))
    joined = checks.join(F.broadcast(rules(projects.sparkSession)), "check")
    return joined.where((F.col("c.score") >= 0) & (F.col("c.score") <= F.col("at_or_below"))).select(
        "source_repo", "code", "detail", F.col("c.reason").alias("reason"), F.col("c.warnings").alias("evidence")
    )


def assess(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """``node_id, source_repo, code, detail, reason, evidence``: one row for each signal.

    Three absences stay apart: a version that was not asked about has no
    signals, one the registry does not know is ``unlisted``, and a known source
    repository without a scorecard says so.
    """
    keys = run_keys(facts)
    none = F.lit(None).cast("array<string>")
    base = facts.where("queried").withColumn("__repo", F.nullif("source_repo", F.lit("")))
    known = base.where("known")
    licences = F.coalesce("licenses", F.array().cast("array<string>"))
    odd = F.exists(licences, lambda x: (F.lower(x) == "non-standard") | (x == ""))
    signal = lambda cond, code, detail: F.when(cond, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    own = F.array(
        signal(F.col("deprecated"), "deprecated", F.coalesce(F.nullif("deprecated_reason", F.lit("")), F.lit("publisher marked this version deprecated"))),
        signal(F.size(licences) == 0, "no-license", F.lit("no license recorded; redistribution terms are undetermined")),
        signal((F.size(licences) > 0) & odd, "non-standard-license", F.array_join(licences, ", ")),
        signal(F.col("__repo").isNull(), "no-source-repo", F.lit("published artifact is not attributable to any source repository")),
        signal(
            F.col("__repo").isNotNull() & ~F.col("provenance").eqNullSafe("SLSA_ATTESTATION"),
            "unattested-source",
            F.concat(F.lit("source repo linked by "), F.lower(F.coalesce("provenance", F.lit(""))), F.lit(" only; provenance not verified")),
        ),
    )
    cols = [*keys, "node_id", "source_repo", "code", "detail", "reason", "evidence"]
    derived = known.select(*keys, "node_id", "source_repo", F.explode(F.array_compact(own)).alias("s")).select(
        *keys, "node_id", "source_repo", "s.code", "s.detail", F.lit("").alias("reason"), none.alias("evidence")
    )
    unlisted = base.where(~F.col("known")).select(
        *keys, "node_id", "source_repo", F.lit("unlisted").alias("code"),
        F.lit("no public registry record; check whether it resolves from a local path (benign) or by name from an index (confusable)").alias("detail"),
        F.lit("").alias("reason"), none.alias("evidence"),
    )
    carded = projects.where("has_scorecard").select(F.col("project_id").alias("__repo"))
    without = known.where(F.col("__repo").isNotNull()).join(carded, "__repo", "left_anti").select(
        *keys, "node_id", "source_repo", F.lit("no-scorecard").alias("code"), F.concat(F.lit("no OpenSSF Scorecard for "), F.col("__repo")).alias("detail"), F.lit("").alias("reason"), none.alias("evidence")
    )
    scored = known.join(scorecard_signals(projects), "source_repo").select(*cols)
    return derived.select(*cols).unionByName(unlisted).unionByName(without.select(*cols)).unionByName(scored)


def signal_counts(signals: DataFrame) -> DataFrame:
    """Per signal: versions, distinct projects, one line of evidence for each
    project, and whether it is a baseline signal; in report order."""
    keys = run_keys(signals)
    order = F.array(*[F.lit(c) for c in SIGNAL_ORDER])
    repo = F.nullif("source_repo", F.lit(""))
    why = F.min_by(F.get("evidence", 0), F.struct("node_id", F.get("evidence", 0)))
    per_project = signals.withColumn("__r", repo).groupBy(*keys, "code", "__r").agg(F.count(F.lit(1)).alias("n"), why.alias("why"))
    lines = F.array_sort(F.collect_list(F.when(F.col("__r").isNotNull() & F.col("why").isNotNull(), F.concat_ws(": ", "__r", "why"))))
    return per_project.groupBy(*keys, "code").agg(F.sum("n").alias("versions"), F.count("__r").alias("projects"), lines.alias("why")).withColumns(
        {"baseline": F.col("code").isin(*BASELINE), "ord": F.array_position(order, F.col("code")).cast("int")}
    )


def indirect_risk(signals: DataFrame, named: DataFrame, pinning: DataFrame) -> DataFrame:
    """``code, versions``: signals on versions nobody here names, without the
    baseline, and how many of those versions float."""
    keys = run_keys(signals, named, pinning)
    away = signals.where(~F.col("code").isin(*BASELINE)).join(named.select(*keys, F.col("id").alias("node_id")).distinct(), [*keys, "node_id"], "left_anti")
    floating = pinning.where("pinning = 'floating'").join(named.select(*keys, F.col("id").alias("node_id")).distinct(), [*keys, "node_id"], "left_anti")
    return (
        away.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("versions")).unionByName(floating.groupBy(*keys, F.lit("floating-version").alias("code")).agg(F.count(F.lit(1)).alias("versions")))
    )
