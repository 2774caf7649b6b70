"""Append-only observations and runs: latest views, changes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(observations: DataFrame, keys: list[str], at: str = "observed_at", tie: str | None = None) -> DataFrame:
    """The newest row of each key; one aggregation instead of a self-join."""
    rest = [c for c in observations.columns if c not in keys]
    order = F.struct(at, tie) if tie else F.col(at)
    return observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("l")).select(*keys, "l.*")


def fresh(observations: DataFrame, keys: list[str], now: Column, max_age: Column, at: str = "observed_at") -> DataFrame:
    """Keys with their newest time and whether it is younger than ``max_age``."""
    return observations.groupBy(*keys).agg(F.max(at).alias("newest")).withColumn("fresh", F.col("newest") > now - max_age)


def repointed(observations: DataFrame, ref: str = "ref", value: str = "resolved", at: str = "observed_at", tie: str | None = None) -> DataFrame:
    """Each observation with the value before it and whether it moved."""
    order = Window.partitionBy(ref).orderBy(at, *([tie] if tie else []))
    return observations.withColumn("previous", F.lag(value).over(order)).withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))


def current_facts(observations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Newest known fact of each package URL that the graph still has."""
    return latest(observations.where("known"), ["purl"]).join(nodes.select(F.col("id").alias("purl")), "purl", "left_semi")


def ranked_runs(runs: DataFrame, project: str = "project") -> DataFrame:
    """Runs with their place in the project, newest first."""
    order = Window.partitionBy(project).orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order))


def latest_runs(runs: DataFrame, project: str = "project") -> DataFrame:
    return ranked_runs(runs, project).where("place = 1").drop("place")


def prune_plan(runs: DataFrame, keep: int | None = None, older_than: Column | None = None, project: str = "project", unclaimed: bool = False) -> DataFrame:
    """Runs that would go: beyond the newest ``keep`` of a project, or before a
    time, or without a project. An empty selection is refused."""
    if keep is None and older_than is None and not unclaimed:
        raise ValueError("select runs to prune: keep, older_than or unclaimed")
    placed = ranked_runs(runs, project)
    go = F.lit(False)
    if keep is not None:
        go = go | (F.col(project).isNotNull() & (F.col("place") > keep))
    if older_than is not None:
        go = go | (F.col("created_at") < older_than)
    if unclaimed:
        go = go | F.col(project).isNull()
    return placed.where(go).drop("place")


def projects_listing(projects: DataFrame, runs: DataFrame, paths: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Projects with run count, newest run and paths; never-run projects last."""
    per = runs.where("project IS NOT NULL").groupBy(F.col("project").alias("num")).agg(F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("newest"))
    places = paths.groupBy("num").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))
    out = projects.where(F.col("key").startswith(prefix)).join(per, "num", "left").join(places, "num", "left")
    out = out.select("num", "key", "name", F.coalesce("runs", F.lit(0)).alias("runs"), "newest", F.coalesce("paths", F.lit("")).alias("paths"))
    out = out.orderBy(F.desc_nulls_last("newest"), "num")
    return out.limit(limit) if limit is not None else out


def not_yet_scanned(repos: DataFrame, runs: DataFrame, on: str = "target") -> DataFrame:
    return repos.join(runs.select(on).distinct(), on, "left_anti")


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, num, name, created_at``: new names win, numbers are never reissued."""
    most = F.coalesce(F.max("num"), F.lit(0)).alias("most")
    fresh_keys = new.join(old.select("key"), "key", "left_anti").select("key", "name", "created_at").dropDuplicates(["key"])
    order = Window.orderBy("created_at", "key")  # new projects of one upsert
    numbered = fresh_keys.withColumn("n", F.row_number().over(order)).join(F.broadcast(old.agg(most)))
    added = numbered.select("key", (F.col("n") + F.col("most")).cast("int").alias("num"), "name", "created_at")
    kept = old.join(new.select("key", F.col("name").alias("__name")).dropDuplicates(["key"]), "key", "left")
    return kept.select("key", "num", F.coalesce("__name", "name").alias("name"), "created_at").unionByName(added)


def packages_page(packages: DataFrame, limit: int, offset: int = 0, ecosystem: str | None = None, direct: bool | None = None) -> DataFrame:
    rows = packages
    if ecosystem is not None:
        rows = rows.where(F.col("ecosystem") == ecosystem)
    if direct is not None:
        rows = rows.where(F.col("direct") == direct)
    return rows.orderBy(F.desc("path_count"), "name", "ecosystem").offset(offset).limit(limit)


def history_candidates(commits: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Commits whose watched content differs from the commit before, by graph
    position and never by time. ``commits``: ``commit_ord, digest``."""
    order = Window.partitionBy(*(partition or [])).orderBy("commit_ord")
    before = F.lag("digest").over(order)
    return commits.where(F.lit(True)).withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("digest"))).drop("__b")


def history_changes(snapshots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Movement between consecutive snapshots.

    ``snapshots``: ``commit_ord`` (consecutive), ``name, declared, installed``.
    ``kind`` is added, removed, range-changed (the declared range moved) or
    version-changed (only the lockfile did).
    """
    keys = keys or []
    cur, prev = snapshots, snapshots.withColumn("commit_ord", F.col("commit_ord") + 1).withColumnsRenamed({"declared": "from_declared", "installed": "from_installed"})
    commits = snapshots.select(*keys, "commit_ord").distinct()
    prev = prev.join(commits, [*keys, "commit_ord"], "left_semi")
    both = cur.withColumn("__now", F.lit(True)).join(prev.withColumn("__then", F.lit(True)), [*keys, "commit_ord", "name"], "full")
    kind = (
        F.when(F.col("__then").isNull(), "added")
        .when(F.col("__now").isNull(), "removed")
        .when(~F.col("declared").eqNullSafe(F.col("from_declared")), "range-changed")
        .when(~F.col("installed").eqNullSafe(F.col("from_installed")), "version-changed")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "commit_ord", "name", "kind", "from_declared", F.col("declared").alias("to_declared"), "from_installed", F.col("installed").alias("to_installed"))
