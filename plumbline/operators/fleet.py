"""Fleet folds: one row per run in, tables over populations out.

Numbers of a fleet are sums of the numbers of its repositories, so everything
here is a second grouping over frames that carry ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.scalars import without_version

SAMPLE_PATHS = r"(^|/)(examples?|samples?|fixtures?|tests?|testdata|__tests__|demos?|e2e|benchmarks?)(/|$)"


def upper_median(value: Column | str) -> Column:
    """The element at position n div 2 of the sorted values, as an aggregate."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def upper_medians(rows: DataFrame, group: list[str], value: str, out: str = "median") -> DataFrame:
    """Upper medians without gathering a group: the row of rank n div 2."""
    order = Window.partitionBy(*group).orderBy(value)
    size = F.count(value).over(Window.partitionBy(*group))
    ranked = rows.where(F.col(value).isNotNull()).select(*group, value, (F.row_number().over(order) - 1).alias("__r"), size.alias("__n"))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*group, F.col(value).alias(out))


def grades(scored: DataFrame) -> DataFrame:
    return scored.where("NOT suppressed").groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def exposure_totals(exposure: DataFrame) -> DataFrame:
    """Exposure summed over repositories, and how many have an affected version."""
    numbers = ("checked", "affected", "malicious", "critical", "high", "other")
    return exposure.groupBy("reach", "surface").agg(
        *[F.sum(n).alias(n) for n in numbers], F.count_if(F.col("affected") > 0).alias("repos_hit"), F.try_divide(F.sum("affected").cast("double"), F.sum("checked")).alias("rate")
    )


def reach_ratio(exposure: DataFrame) -> DataFrame:
    """One row: rates of direct and inherited packages and their ratio."""
    pick = lambda reach, n: F.sum(F.when(F.col("reach") == reach, F.col(n)).otherwise(0))
    direct = F.try_divide(pick("direct", "affected").cast("double"), pick("direct", "checked"))
    inherited = F.try_divide(pick("indirect", "affected").cast("double"), pick("indirect", "checked"))
    return exposure.agg(direct.alias("direct_rate"), inherited.alias("inherited_rate"), F.try_divide(direct, inherited).alias("ratio"))


def leverage(exposure: DataFrame) -> DataFrame:
    """Per run: declared and inherited packages, and inherited per declared."""
    per = exposure.groupBy("run_id").agg(
        F.sum(F.when(F.col("reach") == "direct", F.col("checked")).otherwise(0)).alias("declared"),
        F.sum(F.when(F.col("reach") == "indirect", F.col("checked")).otherwise(0)).alias("inherited"),
    )
    return per.where("declared + inherited > 0").withColumn("multiplier", F.coalesce(F.try_divide(F.col("inherited").cast("double"), F.col("declared")), F.lit(0.0)))


def at_risk(exposure: DataFrame, reach: str = "direct", limit: int | None = None) -> DataFrame:
    """Runs with affected versions, by malicious, critical and rate."""
    numbers = ("checked", "affected", "malicious", "critical", "high")
    per = exposure.where(F.col("reach") == reach).groupBy("run_id").agg(*[F.sum(n).alias(n) for n in numbers]).where("affected > 0")
    rate = F.coalesce(F.try_divide(F.col("affected").cast("double"), F.col("checked")), F.lit(0.0))
    out = per.withColumn("rate", rate).orderBy(F.desc("malicious"), F.desc("critical"), F.desc("rate"), "run_id")
    return out.limit(limit) if limit is not None else out


def introducers(per_run: DataFrame) -> DataFrame:
    """Introducers over the fleet, by name without version."""
    named = per_run.select("run_id", without_version(F.col("direct")).alias("name"), "affected")
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("repos"), F.sum("affected").alias("affected")).orderBy(F.desc("repos"), F.desc("affected"), "name")


def hygiene_bands(pinning: DataFrame, least: int = 10) -> DataFrame:
    """Repositories by their share of floating versions, in five bands; those
    with fewer than ``least`` versions are left out."""
    per = pinning.groupBy("run_id").agg(F.sum(F.when(F.col("pinning") == "floating", F.col("n")).otherwise(0)).alias("floating"), F.sum("n").alias("total")).where(F.col("total") >= least)
    share = F.col("floating") / F.col("total")
    band = F.when(share == 0, "none").when(share < 0.25, "under 25%").when(share < 0.5, "25-50%").when(share < 0.75, "50-75%").otherwise("75% or more")
    return per.withColumn("band", band).groupBy("band").agg(F.count(F.lit(1)).alias("repos"))


def control_shares(controls: DataFrame, assessable: DataFrame) -> DataFrame:
    """Per kind: assessable repositories that have it, and their share."""
    able = assessable.where("assessable").select("run_id")
    total = able.agg(F.count(F.lit(1)).alias("of"))
    found = controls.join(able, "run_id", "left_semi").select("run_id", "kind").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("repos"))
    return found.join(F.broadcast(total)).withColumn("share", F.col("repos") / F.col("of"))


def funnel(runs: DataFrame, stages: dict[str, Column], population: str = "population") -> DataFrame:
    """Per population and stage: how many repositories pass; a repository can
    be in several populations (an array) and always is in 'all'."""
    each = F.explode(F.array_distinct(F.concat(F.array(F.lit("all")), F.coalesce(population, F.array().cast("array<string>"))))).alias("population")
    rows = runs.select(each, *[c.alias(k) for k, c in stages.items()])
    counts = rows.groupBy("population").agg(*[F.count_if(F.col(k)).alias(k) for k in stages])
    return counts.unpivot(["population"], list(stages), "stage", "repos")


def beyond_manifest(nodes: DataFrame) -> DataFrame:
    """Actions and images: how many there are and how many sit on a moving tag."""
    action = F.col("id").startswith("pkg:github/")
    image = F.col("id").startswith("pkg:oci/")
    fixed = F.when(action, F.col("version").rlike("^[0-9a-f]{40}$")).otherwise(F.col("version").startswith("sha256:"))
    rows = nodes.where(action | image).withColumn("what", F.when(action, "action").otherwise("image"))
    return rows.groupBy("what").agg(F.count(F.lit(1)).alias("total"), F.count_if(~fixed).alias("moving"))


def frontier(nodes: DataFrame) -> DataFrame:
    stuck = nodes.where(F.col("completeness").isin("declared", "opaque") & (F.coalesce(F.col("reason"), F.lit("")) != ""))
    return stuck.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("repos"))


def sample_manifests(files: DataFrame) -> DataFrame:
    """Manifests per run, and how many lie under example or test paths."""
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$"))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("manifests"), F.count_if(F.col("path").rlike(SAMPLE_PATHS)).alias("samples"))


def lists(repos: DataFrame, top: int = 100, growing: int = 50, pool: int = 300) -> DataFrame:
    """``full_name, list``: the most starred, and the fastest growing of a pool."""
    days = F.greatest(F.lit(1), F.datediff("pushed_at", "created_at"))
    ranked = repos.where("NOT archived AND NOT fork").withColumn("rate", F.col("stars") / days)
    active = ranked.orderBy(F.desc("stars"), "full_name").limit(top).select("full_name", F.lit("active").alias("list"))
    fast = ranked.orderBy(F.desc("stars"), "full_name").limit(pool).orderBy(F.desc("rate"), "full_name").limit(growing).select("full_name", F.lit("growing").alias("list"))
    return active.union(fast).distinct()


def worst_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("malicious"), F.desc("critical"), F.desc("score"), "ord")
