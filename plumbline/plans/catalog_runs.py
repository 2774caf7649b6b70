"""Queries on observations, runs, projects and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import purl as P
from plumbline.operators import observations as O
from plumbline.plans.base import query, table


def observations(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("purl"), F.col("ts").alias("observed_at"), "event_id", F.col("event_type").alias("resolved"), "value", "props")


@query("""
SELECT purl, event_id, resolved FROM (SELECT user_id AS purl, event_id, event_type AS resolved, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_observation(spark, sf):
    return O.latest(observations(spark, sf), ["purl"], tie="event_id").select("purl", "event_id", "resolved")


@query("""
SELECT event_id, purl, resolved, previous, coalesce(previous <> resolved, false) AS changed FROM (
  SELECT event_id, user_id AS purl, event_type AS resolved, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)""")
def ref_repointed(spark, sf):
    return O.repointed(observations(spark, sf), ref="purl", tie="event_id").select("event_id", "purl", "resolved", "previous", "changed")


@query("SELECT user_id AS purl, max(ts) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR AS fresh FROM events GROUP BY user_id")
def packument_fresh(spark, sf):
    return O.fresh(observations(spark, sf), ["purl"], F.expr("timestamp_ntz'2024-01-30'"), F.expr("INTERVAL 36 HOURS")).select("purl", "fresh")


RUNS_SQL = "runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS project, o_orderdate AS created_at, o_orderpriority AS target FROM orders)"


def runs(spark, sf):
    o = table(spark, sf, "orders")
    project = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    return o.select(F.col("o_orderkey").alias("run_id"), project.alias("project"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("target"))


@query(f"WITH {RUNS_SQL} SELECT project, run_id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run_id DESC) AS rn FROM runs WHERE project IS NOT NULL) WHERE rn = 1")
def runs_latest_per_project(spark, sf):
    return O.latest_runs(runs(spark, sf).where("project IS NOT NULL")).select("project", "run_id")


@query(f"""
WITH {RUNS_SQL}
SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run_id DESC) AS rn FROM runs)
WHERE (project IS NOT NULL AND rn > 3) OR created_at < TIMESTAMP '1993-01-01'""")
def prune_plan(spark, sf):
    return O.prune_plan(runs(spark, sf), keep=3, older_than=F.expr("timestamp_ntz'1993-01-01'")).select("run_id")


@query(f"WITH {RUNS_SQL} SELECT run_id FROM runs WHERE project IS NULL")
def unclaimed_runs(spark, sf):
    return O.prune_plan(runs(spark, sf), unclaimed=True).select("run_id")


@query(f"""
WITH {RUNS_SQL}, r AS (SELECT project, count(*) AS runs, max(created_at) AS newest FROM runs WHERE project IS NOT NULL GROUP BY project)
SELECT c_custkey AS num, lower(c_mktsegment) || '/' || c_custkey AS key, c_name AS name, CAST(coalesce(runs, 0) AS BIGINT) AS runs, CAST(newest AS VARCHAR) AS newest, 'n' || c_nationkey AS paths
FROM customer LEFT JOIN r ON project = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY r.newest DESC NULLS LAST, c_custkey LIMIT 50""")
def projects_listing(spark, sf):
    c = table(spark, sf, "customer")
    projects = c.select(F.col("c_custkey").alias("num"), F.concat_ws("/", F.lower("c_mktsegment"), "c_custkey").alias("key"), F.col("c_name").alias("name"))
    paths = c.select(F.col("c_custkey").alias("num"), F.concat(F.lit("n"), "c_nationkey").alias("path"))
    return O.projects_listing(projects, runs(spark, sf), paths, prefix="building/", limit=50).withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {RUNS_SQL} SELECT c_custkey AS repo FROM customer WHERE c_custkey NOT IN (SELECT project FROM runs WHERE project IS NOT NULL AND created_at >= TIMESTAMP '1997-01-01')")
def resume_antijoin(spark, sf):
    done = runs(spark, sf).where("project IS NOT NULL AND created_at >= timestamp_ntz'1997-01-01'").select(F.col("project").alias("repo"))
    return O.not_yet_scanned(table(spark, sf, "customer").select(F.col("c_custkey").alias("repo")), done, on="repo")


SNAP_SQL = """ord AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS commit_ord, event_type, value FROM events),
snap AS (SELECT user_id, commit_ord, event_type AS name, CAST(floor(value) AS BIGINT) AS declared, CAST(floor(value * 10) AS BIGINT) AS installed FROM ord)"""


def snapshots(spark, sf):
    """Each user's events as commits that hold one package each."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("commit_ord", F.row_number().over(order) - 1)
    return e.select("user_id", "commit_ord", F.col("event_type").alias("name"), F.floor("value").alias("declared"), F.floor(F.col("value") * 10).alias("installed"))


@query(f"""
WITH {SNAP_SQL},
b AS (SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.commit_ord, p.commit_ord + 1) AS commit_ord, coalesce(c.name, p.name) AS name,
    p.declared AS from_declared, c.declared AS to_declared, p.installed AS from_installed, c.installed AS to_installed, c.name IS NOT NULL AS now, p.name IS NOT NULL AS th
  FROM snap c FULL JOIN (SELECT * FROM snap s WHERE EXISTS (SELECT 1 FROM snap n WHERE n.user_id = s.user_id AND n.commit_ord = s.commit_ord + 1)) p
    ON c.user_id = p.user_id AND c.commit_ord = p.commit_ord + 1 AND c.name = p.name)
SELECT user_id, CAST(commit_ord AS INTEGER) AS commit_ord, name, CASE WHEN NOT th THEN 'added' WHEN NOT now THEN 'removed' WHEN from_declared <> to_declared THEN 'range-changed' ELSE 'version-changed' END AS kind,
  from_declared, to_declared, from_installed, to_installed
FROM b WHERE NOT th OR NOT now OR from_declared <> to_declared OR from_installed <> to_installed""")
def history_changes(spark, sf):
    return O.history_changes(snapshots(spark, sf), keys=["user_id"])


@query(f"""
WITH {SNAP_SQL}
SELECT user_id, CAST(commit_ord AS INTEGER) AS commit_ord, name FROM (SELECT *, lag(name) OVER (PARTITION BY user_id ORDER BY commit_ord) AS before FROM snap) WHERE before IS NULL OR before <> name""")
def history_candidates(spark, sf):
    rows = snapshots(spark, sf).select("user_id", "commit_ord", "name", F.col("name").alias("digest"))
    return O.history_candidates(rows, ["user_id"]).select("user_id", "commit_ord", "name")


@query(r"""
SELECT page_id, lower(host || '/' || path) AS key, path AS name FROM (
  SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/?#]*)', 1), ':[0-9]+$', '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+', ''), '/+$', ''), '\.git$', '') AS path FROM pages)
WHERE host <> '' AND path <> ''""")
def canonical_remote(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.canonical_remote("url").alias("r")).where("r IS NOT NULL").select("page_id", "r.key", "r.name")


@query("SELECT page_id, 'pkg:generic/buildfile/workflow@' || left(sha256(url), 12) || '#' || url AS id FROM pages")
def buildfile_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.build_file_id("workflow", "url").alias("id"))


WEB_SQL = "l AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, url AS link FROM pages)"


def web(spark, sf):
    """Hosts as build files and their pages as the artifacts they name."""
    links = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.col("url").alias("link"))
    edges = links.select(P.build_file_id("workflow", "host").alias("from_id"), F.col("link").alias("to_id"))
    return edges, links.select(F.col("link").alias("id"), F.when(F.col("link").startswith("http:"), "unpinned-ref").alias("reason")).distinct()


@query(f"""
WITH {WEB_SQL}
SELECT host AS file, array_to_string(list_sort(list(link)), ' ') AS names, CAST(count(*) FILTER (WHERE link LIKE 'http:%') AS BIGINT) AS moving FROM l GROUP BY host""")
def surface_files(spark, sf):
    from plumbline.operators.findings import surface_files as files

    edges, nodes = web(spark, sf)
    return files(edges, nodes).select("file", F.array_join("names", " ").alias("names"), "moving")


@query(f"WITH {WEB_SQL} SELECT host AS file, link FROM l WHERE link LIKE 'http:%'")
def moving_refs(spark, sf):
    edges, nodes = web(spark, sf)
    moved = edges.join(nodes.where("reason = 'unpinned-ref'"), edges["to_id"] == nodes["id"])
    return moved.select(F.regexp_extract("from_id", "#(.*)$", 1).alias("file"), F.col("to_id").alias("link"))
