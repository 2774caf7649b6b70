"""Queries over whole tables for functions, orders, pins, walks and components."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import purl as P
from plumbline.functions import scalars as S
from plumbline.operators import controls as C
from plumbline.operators import enumerate as E
from plumbline.operators import findings as FI
from plumbline.operators import fleet as FL
from plumbline.operators import graph as G
from plumbline.operators import observations as O
from plumbline.operators import posture as PO
from plumbline.operators import rollup as R
from plumbline.plans.base import query, table
from plumbline.plans.catalog_findings import EXPOSE_SQL, exposed
from plumbline.plans.walk import EDGE, NODE, Bounds, walk

# --- functions -----------------------------------------------------------------


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'GitHub Actions' ELSE 'purl' END AS ecosystem,
  CASE p_partkey % 4 WHEN 0 THEN 'o/a' || p_partkey WHEN 1 THEN 'pkg:golang/github.com/ns/terraform-provider-a' || p_partkey || '@v1.' || p_size
    WHEN 2 THEN 'pkg:golang/github.com/hashicorp/terraform@v1.' || p_size ELSE 'pkg:npm/a' || p_partkey || '@1.' || p_size END AS key
FROM part""")
def advisory_keys(spark, sf):
    """What advisories of actions, providers, the Terraform CLI and packages are filed under."""
    kind, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    at = F.concat(F.lit("@1."), F.col("p_size"))
    node = (
        F.when(kind == 0, F.concat(F.lit("pkg:github/o/a"), n, F.lit("@v1"))).when(kind == 1, F.concat(F.lit("pkg:terraform/ns/a"), n, at))
        .when(kind == 2, F.concat(F.lit("pkg:terraform-cli/terraform"), at)).otherwise(F.concat(F.lit("pkg:npm/a"), n, at))
    )
    return table(spark, sf, "part").select("p_partkey", P.advisory_key(node).alias("k")).select("p_partkey", "k.ecosystem", "k.key")


@query("""
SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 8) || '…' END AS cut,
  CASE WHEN length(p_name) <= 7 THEN p_name ELSE substr(p_name, 1, 3) || '…' || right(p_name, 3) END AS middle,
  repeat('█', CAST(floor(p_size / 50.0 * 20 + 0.5) AS INTEGER)) || repeat('░', 20 - CAST(floor(p_size / 50.0 * 20 + 0.5) AS INTEGER)) AS share,
  'p' || p_partkey AS name, replace(replace(p_brand, '#', '-'), ' ', '-') || '-' || p_partkey AS file
FROM part""")
def text_shaping(spark, sf):
    """Truncation, elision, bars, names without versions, and file names."""
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", S.truncate(name, 9).alias("cut"), S.elide_middle(name, 7).alias("middle"), S.bar(F.col("p_size") / 50).alias("share"),
        S.without_version(F.concat(F.lit("p"), "p_partkey", F.lit("@1."), "p_size")).alias("name"), S.safe_name(F.concat(F.lit(".."), "p_brand", F.lit("/"), "p_partkey")).alias("file"),
    )


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def parsed_times(spark, sf):
    """Dates and RFC 3339 times, with and without an offset, read back."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.date_format("o_orderdate", "'T'HH:mm:ss'Z'"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.date_format("o_orderdate", "'T'HH:mm:ss'+00:00'")))
    text = text.otherwise(F.concat(day, F.date_format("o_orderdate", "' 'HH:mm:ss")))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp(S.parse_time(text)).alias("seconds"))


@query("SELECT p_size % 6 AS kind, count(*) AS n, p_size % 6 IN (0, 2, 3) AS tag FROM part GROUP BY p_size")
def dist_tags(spark, sf):
    """Which specs name a moving tag of a package rather than versions."""
    spec = F.element_at(F.array(*[F.lit(x) for x in ("latest", "^1.2.3", " Next ", "main", "v1.0.0", "*")]), F.col("p_size") % 6 + 1)
    rows = table(spark, sf, "part").select("p_size", (F.col("p_size") % 6).alias("kind"), S.is_dist_tag(spec).alias("tag"))
    return rows.groupBy("p_size", "kind", "tag").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", "tag")


# --- surfaces, owners, orders -------------------------------------------------------


SURFACE_SQL = """SELECT 'pkg:npm/p' || l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'manifest' WHEN 'N' THEN 'ci' ELSE 'dockerfile' END AS surface
FROM lineitem WHERE l_returnflag <> 'A' OR l_linestatus = 'F'"""


@query(f"SELECT DISTINCT id, surface FROM ({SURFACE_SQL})")
def surfaces_named(spark, sf):
    """Where order lines, as edges of a root, a workflow and a Dockerfile, name parts;
    placements and edges between packages name nothing."""
    lines = table(spark, sf, "lineitem")
    to = F.concat(F.lit("pkg:npm/p"), "l_partkey")
    source = F.when(F.col("l_returnflag") == "A", "pkg:generic/app@1").when(F.col("l_returnflag") == "N", "pkg:generic/buildfile/workflow@1#ci.yml").otherwise("pkg:generic/buildfile/dockerfile@1#Dockerfile")
    placed = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    edges = lines.select(source.alias("from_id"), to.alias("to_id"), F.when(placed, "").otherwise("^1").alias("spec"), F.when(placed, "placement").otherwise("declared").alias("origin"))
    between = lines.select(to.alias("from_id"), F.concat(F.lit("pkg:npm/s"), "l_suppkey").alias("to_id"), F.lit("*").alias("spec"), F.lit("declared").alias("origin"))
    return FI.surfaces(edges.union(between))


@query(f"""
WITH {EXPOSE_SQL},
own AS (SELECT DISTINCT 'pkg:npm/p' || l_partkey AS node_id, CASE WHEN l_linenumber = 1 THEN '.' ELSE 'apps/' || l_linenumber END AS owner FROM lineitem WHERE l_linestatus = 'O'
  UNION SELECT DISTINCT 'pkg:npm/p' || l_partkey, 'Dockerfile' FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(owner, '-') AS owner, count(*) FILTER (WHERE label = 'MALICIOUS') AS malicious, count(*) FILTER (WHERE label = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE label = 'HIGH') AS high, count(*) FILTER (WHERE label NOT IN ('MALICIOUS', 'CRITICAL', 'HIGH')) AS other
FROM fnd LEFT JOIN own USING (node_id) GROUP BY 1""")
def findings_by_owner(spark, sf):
    """Findings per application folder or build file that holds the package."""
    lines = table(spark, sf, "lineitem")
    node = F.concat(F.lit("pkg:npm/p"), "l_partkey")
    folder = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("apps/"), "l_linenumber"))
    instances = lines.where("l_linestatus = 'O'").select(F.concat(folder, F.lit("#node_modules/p"), "l_partkey").alias("locator"), node.alias("node_id"))
    edges = lines.where("l_returnflag = 'R'").select(F.lit("pkg:generic/buildfile/dockerfile@1#Dockerfile").alias("from_id"), node.alias("to_id"))
    return FI.by_owner(exposed(spark, sf)[1], FI.node_owners(instances, edges))


@query(f"""
WITH {EXPOSE_SQL}
SELECT row_number() OVER (ORDER BY CASE label WHEN 'MALICIOUS' THEN 5 WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 ELSE 2 END DESC, node_id, osv_id) AS place, node_id, osv_id FROM fnd ORDER BY place LIMIT 100""")
def findings_worst(spark, sf):
    """The report's top hundred findings in its order."""
    top = FI.ordered(exposed(spark, sf)[1]).limit(100)
    rank = F.row_number().over(Window.orderBy(S.severity_rank(F.col("label")).desc(), "node_id", "osv_id"))
    return top.select(rank.cast("long").alias("place"), "node_id", "osv_id")


@query("""
WITH a AS (SELECT 'pkg:github/o/a' || (p_partkey % 60) || '@v' || (p_partkey % 3) AS node_id, p_partkey, CASE WHEN p_size >= 48 THEN 4 WHEN p_size >= 44 THEN 3 WHEN p_size >= 20 THEN 2 ELSE 0 END AS r FROM part)
SELECT node_id, regexp_extract(node_id, 'pkg:github/([^@]*)', 1) AS action, regexp_extract(node_id, '@(.*)$', 1) AS ref, max(r) AS worst, count(*) AS n FROM a GROUP BY node_id""")
def action_severity(spark, sf):
    """Findings on actions and the worst severity of each."""
    part = table(spark, sf, "part")
    band = F.when(F.col("p_size") >= 48, "CRITICAL").when(F.col("p_size") >= 44, "HIGH").when(F.col("p_size") >= 20, "MODERATE").otherwise("")
    node = F.format_string("pkg:github/o/a%d@v%d", F.col("p_partkey") % 60, F.col("p_partkey") % 3)
    rows = part.select(node.alias("node_id"), F.concat(F.lit("A"), "p_partkey").alias("osv_id"), band.alias("severity"), F.lit("s").alias("summary"), F.array().cast("array<string>").alias("aliases"))
    found = FI.action_findings(FI.dedupe(rows))
    return found.groupBy("node_id", "action", "ref").agg(F.count(F.lit(1)).alias("n")).join(FI.worst_per_node(found), "node_id")


# --- posture, controls, fleet -----------------------------------------------------------


@query("""
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unmaintained' WHEN 1 THEN 'no-license' WHEN 2 THEN 'no-scorecard' ELSE 'deprecated' END AS code FROM part),
named AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 5), away AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM named))
SELECT code, count(*) AS versions FROM s WHERE code <> 'no-scorecard' AND p_partkey IN (SELECT p_partkey FROM away) GROUP BY code
UNION ALL SELECT 'floating-version', count(*) FROM away WHERE p_size <= 20 HAVING count(*) > 0""")
def indirect_posture(spark, sf):
    """Signals and floating versions among parts that no returned fifth line names."""
    part, node = table(spark, sf, "part"), F.concat(F.lit("pkg:npm/p"), "p_partkey")
    code = F.element_at(F.array(*[F.lit(x) for x in ("unmaintained", "no-license", "no-scorecard", "deprecated")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    named = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 5").select(F.concat(F.lit("pkg:npm/p"), "l_partkey").alias("id"), F.lit("manifest").alias("surface")).distinct()
    pinning = part.select(node.alias("node_id"), F.when(F.col("p_size") <= 20, "floating").otherwise("locked").alias("pinning"))
    return PO.indirect_risk(part.select(node.alias("node_id"), code.alias("code")), named, pinning)


@query("""
WITH c AS (SELECT l_suppkey AS run_id, CASE WHEN l_linenumber % 2 = 0 THEN 'trivy fs .' ELSE 'sudo A=1 /usr/bin/gitleaks detect' END AS cmd, 'f' || l_linenumber AS src FROM lineitem),
d AS (SELECT DISTINCT run_id, CASE WHEN cmd LIKE 'trivy%' THEN 'Trivy' ELSE 'gitleaks' END AS tool, src FROM c)
SELECT run_id, tool, least(6, count(*)) AS shown FROM d GROUP BY run_id, tool""")
def controls_evidence(spark, sf):
    """Controls that build steps run, with at most six distinct sources each."""
    lines = table(spark, sf, "lineitem")
    note = F.when(F.col("l_linenumber") % 2 == 0, "trivy fs .").otherwise("sudo A=1 /usr/bin/gitleaks detect")
    steps = lines.select(F.col("l_suppkey").alias("run_id"), F.format_string("pkg:generic/step/%d-%d@1", "l_orderkey", "l_linenumber").alias("id"), F.lit("opaque").alias("completeness"), note.alias("note"), F.concat(F.lit("f"), "l_linenumber").alias("source"))
    return C.detect(steps).select("run_id", "tool", F.size("evidence").cast("long").alias("shown"))


@query("""
SELECT CASE WHEN c_custkey % 3 = 0 THEN 'bound:depth' ELSE 'offline' END AS reason, count(*) AS n, count(DISTINCT c_nationkey) AS repos
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 <> 2 GROUP BY 1""")
def fleet_frontier(spark, sf):
    """Why closures of a fleet ended, and in how many repositories."""
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "declared").when(F.col("c_mktsegment") == "MACHINERY", "opaque").otherwise("resolved")
    reason = F.when(F.col("c_custkey") % 3 == 0, "bound:depth").when(F.col("c_custkey") % 3 == 1, "offline").otherwise("")
    return FL.frontier(table(spark, sf, "customer").select(F.col("c_nationkey").alias("run_id"), kind.alias("completeness"), reason.alias("reason")))


@query("""
SELECT l_suppkey AS run_id, count(*) AS manifests, count(*) FILTER (WHERE l_linenumber IN (1, 2)) AS samples FROM lineitem WHERE l_linenumber <> 4 GROUP BY l_suppkey""")
def manifest_samples(spark, sf):
    """Manifests per repository, and those under example and test paths."""
    names = ("examples/%d/package.json", "a/__tests__/%d/package.json", "a/%d/package.json", "a/%d/package-lock.json", "latest/%d/package.json", "b/%d/package.json", "package.json")
    path = F.format_string("x/%s", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")))
    path = F.replace(path, F.lit("%d"), F.col("l_orderkey").cast("string"))
    return FL.sample_manifests(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run_id"), path.alias("path")))


@query("""
WITH r AS (SELECT c_name AS full_name, CAST(floor(c_acctbal) AS BIGINT) AS stars, 1 + c_custkey % 900 AS days FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0),
p AS (SELECT * FROM r ORDER BY stars DESC, full_name LIMIT 90)
SELECT full_name, 'active' AS list FROM (SELECT * FROM r ORDER BY stars DESC, full_name LIMIT 40)
UNION SELECT full_name, 'growing' FROM (SELECT * FROM p ORDER BY stars / days::DOUBLE DESC, full_name LIMIT 20)""")
def repository_lists(spark, sf):
    """The most starred and the fastest growing of a pool."""
    born = F.lit("2020-01-01").cast("date")
    repos = table(spark, sf, "customer").select(
        F.col("c_name").alias("full_name"), F.floor("c_acctbal").alias("stars"), born.alias("created_at"), F.date_add(born, (1 + F.col("c_custkey") % 900).cast("int")).alias("pushed_at"),
        (F.col("c_custkey") % 7 == 0).alias("archived"), (F.col("c_custkey") % 11 == 0).alias("fork"),
    )
    return FL.lists(repos, top=40, growing=20, pool=90)


@query("""
SELECT l_suppkey AS ord, count(*) FILTER (WHERE l_quantity = 50) AS malicious, count(*) FILTER (WHERE l_quantity >= 45) AS critical, CAST(sum(l_linenumber) AS BIGINT) AS score
FROM lineitem GROUP BY l_suppkey ORDER BY malicious DESC, critical DESC, score DESC, ord LIMIT 20""")
def repositories_worst(spark, sf):
    """The fleet's twenty worst repositories."""
    n = F.count_if
    per = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ord")).agg(n(F.col("l_quantity") == 50).alias("malicious"), n(F.col("l_quantity") >= 45).alias("critical"), F.sum("l_linenumber").alias("score"))
    return FL.worst_first(per).limit(20)


@query("""
WITH o AS (SELECT 'pkg:npm/u' || user_id AS purl, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error')
SELECT purl, event_id FROM o WHERE rn = 1 AND purl IN (SELECT 'pkg:npm/u' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def facts_in_graph(spark, sf):
    """The newest known fact of every package that the graph still has."""
    at = F.struct("ts", "event_id")
    obs = table(spark, sf, "events").select(F.concat(F.lit("pkg:npm/u"), "user_id").alias("purl"), (F.col("event_type") != "error").alias("known"), at.alias("observed_at"), "event_id")
    nodes = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("pkg:npm/u"), "c_custkey").alias("id"))
    return O.current_facts(obs, nodes).select("purl", "event_id")


# --- versions ---------------------------------------------------------------------


PYPI_SQL = """v AS (
  SELECT DISTINCT 'p' || (p_partkey % 40) AS name, p_size, p_partkey % 7 AS minor, (p_partkey % 40 < 5 OR p_partkey % 3 = 0) AS pre FROM part),
m AS (SELECT *, bool_or(NOT pre) OVER (PARTITION BY name) AS stable FROM v WHERE p_size > 20 OR (p_size = 20 AND (minor > 0 OR NOT pre))),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_size DESC, minor DESC, pre) AS place FROM m WHERE NOT pre OR NOT stable)
SELECT name, p_size || '.' || minor || CASE WHEN pre THEN 'rc1' ELSE '' END AS version, place FROM k WHERE place <="""


def pypi(spark, sf, mode, most=25):
    pre = (F.col("p_partkey") % 40 < 5) | (F.col("p_partkey") % 3 == 0)
    version = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 7, F.when(pre, "rc1").otherwise(""))
    registry = table(spark, sf, "part").select(F.lit("pypi").alias("ecosystem"), F.concat(F.lit("p"), F.col("p_partkey") % 40).alias("name"), version.alias("version"), F.lit(None).cast("timestamp").alias("published_at")).distinct()
    asks = registry.select("ecosystem", "name").distinct().withColumn("spec", F.lit(">=20"))
    return E.enumerate_versions(asks, registry, mode, most).select("name", "version", F.col("place").cast("long").alias("place"))


@query(f"WITH {PYPI_SQL} 3")
def pypi_can(spark, sf):
    """The three newest releases in a range; pre-releases only where nothing else is."""
    return pypi(spark, sf, "can", 3)


@query(f"WITH {PYPI_SQL} 1")
def pypi_will(spark, sf):
    return pypi(spark, sf, "will")


@query("""
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '1.' || (p_partkey % 9) || '.0' WHEN p_partkey % 5 = 1 THEN '9.9.9' END AS pin FROM part)
SELECT 'p' || k AS name, coalesce(pin, '1.8.0') AS version, CASE WHEN pin = '9.9.9' THEN 'error:pin-not-found' END AS reason FROM p""")
def pin_override(spark, sf):
    """Lockfile pins override what would be picked; an unlisted pin says so."""
    part = table(spark, sf, "part")
    name = F.concat(F.lit("p"), "p_partkey")
    registry = part.select(F.lit("npm").alias("ecosystem"), name.alias("name"), F.explode(F.array(*[F.lit(f"1.{i}.0") for i in range(9)])).alias("version"), F.lit(None).cast("timestamp").alias("published_at"))
    asks = part.select(F.lit("npm").alias("ecosystem"), name.alias("name"), F.lit("^1.0.0").alias("spec"))
    pin = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("1."), F.col("p_partkey") % 9, F.lit(".0"))).when(F.col("p_partkey") % 5 == 1, "9.9.9")
    pins = part.select(F.lit("npm").alias("ecosystem"), name.alias("name"), pin.alias("version")).where("version IS NOT NULL")
    return E.apply_pins(asks, E.enumerate_versions(asks, registry, "will"), pins, registry).select("name", "version", "reason")


@query("""
SELECT 'pkg:npm/p' || p_partkey || '@1.0.0' AS id, CASE WHEN p_partkey % 3 = 0 THEN '=1.0.0' ELSE '^1' END AS spec FROM part WHERE p_partkey % 3 <> 2""")
def bare_specs(spark, sf):
    """Specs of a version from its own edge, else from the version-less node of its name."""
    part, name = table(spark, sf, "part"), F.concat(F.lit("p"), "p_partkey")
    bare, own = F.concat(F.lit("pkg:npm/"), name), F.concat(F.lit("pkg:npm/"), name, F.lit("@1.0.0"))
    eco = F.lit("npm").alias("ecosystem")
    nodes = part.select(own.alias("id"), eco, name.alias("name"), F.lit("1.0.0").alias("version")).union(part.select(bare, eco, name, F.lit("")))
    edges = part.where("p_partkey % 3 < 2").select(F.lit("root").alias("from_id"), bare.alias("to_id"), F.lit("^1").alias("spec")).union(part.where("p_partkey % 3 = 0").select(F.lit("root"), own, F.lit("=1.0.0")))
    return R.specs_of(nodes, edges).select("id", "spec")


# --- the closure walk -----------------------------------------------------------------
# Part k has the versions 1.0.0, 1.1.0 and 2.0.0 and needs part k div 10, with ^1.0.0 if
# k is even, else >=1.0.0. The root needs the parts of the largest size. Walks are whole: no bound on nodes.

WALK_SQL = """WITH RECURSIVE n(k, v) AS (
  SELECT p_partkey, v FROM part, (SELECT unnest({root}) AS v) WHERE p_size = 50
  UNION
  SELECT n.k // 10, unnest(CASE WHEN n.k % 2 = 0 THEN {even} ELSE {odd} END) FROM n WHERE n.k >= 10)
SELECT DISTINCT 'pkg:npm/p' || k || '@' || v AS id, 'resolved' AS completeness FROM n"""


def walked(spark, sf, bounds, pins=None):
    part = table(spark, sf, "part")
    eco, name = F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "p_partkey")
    dated = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(t).cast("timestamp").alias("t")) for v, t in (("1.0.0", "2020-01-01"), ("1.1.0", "2021-01-01"), ("2.0.0", "2022-01-01"))])
    versions = part.select(eco, name.alias("name"), F.explode(dated).alias("x")).select("ecosystem", "name", F.col("x.v").alias("version"), F.col("x.t").alias("published_at"))
    spec = F.when(F.col("p_partkey") % 2 == 0, "^1.0.0").otherwise(">=1.0.0")
    needs = part.where("p_partkey >= 10").select(eco, name.alias("name"), F.explode(F.array(*[F.lit(v) for v in ("1.0.0", "1.1.0", "2.0.0")])).alias("version"), F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 10)).alias("dep_name"), spec.alias("spec"), F.lit("prod").alias("scope"))
    root = "pkg:generic/app@1"
    asked = part.where("p_size = 50").select(F.lit(root).alias("from_id"), F.concat(F.lit("pkg:npm/"), name).alias("to_id"), F.lit("depends_on").alias("kind"), F.lit("^1.0.0").alias("spec"), F.lit("prod").alias("scope"), F.lit("declared").alias("origin"))
    none = spark.createDataFrame([], NODE)
    edges = spark.createDataFrame([], EDGE).unionByName(asked)
    return walk(none, edges, root, versions, needs, bounds, pins).nodes.where("ecosystem = 'npm'").select("id", "completeness")


@query(WALK_SQL.format(root="['1.1.0']", even="['1.1.0']", odd="['2.0.0']"))
def walk_will(spark, sf):
    """What an install would take: one version for each requirement."""
    return walked(spark, sf, Bounds(max_nodes=None))


@query(WALK_SQL.format(root="['1.0.0', '1.1.0']", even="['1.0.0', '1.1.0']", odd="['1.0.0', '1.1.0', '2.0.0']"))
def walk_can(spark, sf):
    """Every version that the requirements allow."""
    return walked(spark, sf, Bounds(mode="can", max_nodes=None))


@query(WALK_SQL.format(root="['1.0.0']", even="['1.0.0']", odd="['1.0.0']"))
def walk_as_of(spark, sf):
    """The closure as an install of mid-2020 would have found it."""
    return walked(spark, sf, Bounds(as_of=datetime(2020, 6, 1), max_nodes=None))


@query("""WITH RECURSIVE n(k, v) AS (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '1.0.0' ELSE '1.1.0' END FROM part WHERE p_size = 50
  UNION
  SELECT n.k // 10, CASE WHEN (n.k // 10) % 4 = 0 THEN '1.0.0' WHEN n.k % 2 = 0 THEN '1.1.0' ELSE '2.0.0' END FROM n WHERE n.k >= 10)
SELECT DISTINCT 'pkg:npm/p' || k || '@' || v AS id, 'resolved' AS completeness FROM n""")
def walk_pins(spark, sf):
    """The closure under a lockfile that pins every fourth part."""
    pins = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.lit("1.0.0").alias("version"))
    return walked(spark, sf, Bounds(max_nodes=None), pins)


# --- components on a whole cyclic graph ---------------------------------------------------
# Parts of one brand and size are a ring; the first of a ring points to the first of the
# brand's next size, so that rings are the components and sizes their order.


def rings(spark, sf):
    ring = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    whole = Window.partitionBy("p_brand", "p_size")
    rows = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", F.lead("p_partkey").over(ring).alias("after"), F.min("p_partkey").over(whole).alias("first"))
    around = rows.select(F.col("p_partkey").alias("from_id"), F.coalesce("after", "first").alias("to_id"))
    heads = rows.where("p_partkey = first").select("p_brand", "p_size", "first")
    onward = heads.select(F.col("first").alias("from_id"), F.lead("first").over(Window.partitionBy("p_brand").orderBy("p_size")).alias("to_id")).where("to_id IS NOT NULL")
    return rows.select(F.col("p_partkey").alias("id")), around.union(onward)


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS component FROM part")
def scc_rings(spark, sf):
    """Strongly connected components of all parts, by the distributed form."""
    found = G.scc(*rings(spark, sf))
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component").select("id", F.col("least").alias("component"))
