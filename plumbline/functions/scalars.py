"""Ranks, labels and text shaping as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("MALICIOUS", "CRITICAL", "HIGH", "MODERATE", "LOW", "UNKNOWN")
#: Tags that name a moving version of a package.
DIST_TAGS = (
    "latest", "next", "beta", "alpha", "canary", "rc", "dev", "nightly", "stable", "edge", "lts", "current", "experimental",
    "insiders", "preview", "main",
)


def is_malicious(osv_id: Column, aliases: Column) -> Column:
    return osv_id.startswith("MAL-") | F.coalesce(F.exists(aliases, lambda a: a.startswith("MAL-")), F.lit(False))


def severity_label(osv_id: Column, severity: Column, aliases: Column) -> Column:
    return F.when(is_malicious(osv_id, aliases), "MALICIOUS").otherwise(F.coalesce(F.nullif(severity, F.lit("")), F.lit("UNKNOWN")))


def cve_of(osv_id: Column, aliases: Column) -> Column:
    """The first CVE alias, else the id if it is one, else null."""
    return F.coalesce(F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), 0), F.when(osv_id.startswith("CVE-"), osv_id))


def severity_rank(label: Column) -> Column:
    """5 for malicious down to 1 for low, 0 for anything else."""
    out = None
    for rank, name in zip((5, 4, 3, 2, 1), SEVERITIES):
        out = F.when(label.startswith(name), rank) if out is None else out.when(label.startswith(name), rank)
    return out.otherwise(0)


def upgrade_rank(completeness: Column) -> Column:
    """What a node keeps when two sources disagree: the larger."""
    return F.when(completeness == "resolved", 3).when(completeness == "inferred", 2).when(completeness == "declared", 1).otherwise(0)


def worse_rank(completeness: Column) -> Column:
    """What a summary reports: the larger. Not the reverse of upgrade_rank()."""
    return F.when(completeness == "opaque", 3).when(completeness == "declared", 2).when(completeness == "inferred", 1).otherwise(0)


def install_state(instances: Column, run_has_instances: Column) -> Column:
    return F.when(instances > 0, "installed").when(run_has_instances, "possible").otherwise("unknown")


def error_kind(message: Column) -> Column:
    """404, ratelimit or fetch, by status codes in the message."""
    return F.when(message.rlike(r"\b404\b|(?i)not found"), "404").when(message.rlike(r"\b429\b|(?i)rate.?limit"), "ratelimit").otherwise("fetch")


def is_dist_tag(spec: Column) -> Column:
    return F.lower(F.trim(spec)).isin(*DIST_TAGS)


def known_at(published: Column, withdrawn: Column, at: Column) -> Column:
    """What was public and not withdrawn at a time; a null time filters nothing."""
    return at.isNull() | ((published.isNull() | (published <= at)) & (withdrawn.isNull() | (withdrawn > at)))


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substr(x, F.lit(1), F.lit(n - 1)), F.lit("…")))


def elide_middle(x: Column, n: int) -> Column:
    head = (n - 1) // 2
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substr(x, F.lit(1), F.lit(head)), F.lit("…"), F.right(x, F.lit(n - 1 - head))))


def without_version(label: Column) -> Column:
    return F.regexp_replace(label, r"(?<=.)@[^@]*$", "")


def bar(share: Column, width: int = 20) -> Column:
    full = F.floor(share * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def safe_name(x: Column) -> Column:
    """A file name: other characters become dashes, leading dots go."""
    return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), r"^\.+", "")


def parse_time(x: Column) -> Column:
    """RFC 3339 or a date; anything else raises."""
    return F.when(x.isNull(), None).otherwise(
        F.coalesce(F.try_to_timestamp(x), F.raise_error(F.concat(F.lit("not a time: "), x)).cast("timestamp"))
    )
