"""Package queries: rollups, pinning, ranges, version conformance."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from plumbline.functions import versions as V
from plumbline.operators import enumerate as E
from plumbline.operators import observations as O
from plumbline.operators import rollup as R
from plumbline.plans.base import query, table

# parts as packages: brand names, numeric versions, one spec per part
PKG_SQL = """pkg AS (
  SELECT p_partkey, lower(replace(p_brand, '#', '')) AS name, p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) AS version,
    CASE p_partkey % 3 WHEN 0 THEN p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7) WHEN 1 THEN '^' || p_size || '.0.0' ELSE '' END AS spec
  FROM part),
ver AS (SELECT DISTINCT 'pkg:npm/' || name || '@' || version AS id, name, version FROM pkg),
sp AS (SELECT DISTINCT 'pkg:npm/' || name || '@' || version AS id, spec FROM pkg WHERE spec <> ''),
inst AS (SELECT 'pkg:npm/' || name || '@' || version AS id, count(*) AS n FROM lineitem JOIN pkg ON p_partkey = l_partkey WHERE l_quantity >= 48 GROUP BY 1),
pins AS (SELECT id, min(spec) FILTER (WHERE spec NOT LIKE '^%') AS exact, min(spec) AS any_spec FROM sp GROUP BY id),
vr AS (
  SELECT ver.id AS node_id, name, version, CASE WHEN n > 0 THEN 'installed' ELSE 'possible' END AS state,
    CASE WHEN exact IS NOT NULL THEN 'pinned' WHEN n > 0 THEN 'locked' ELSE 'floating' END AS pinning,
    coalesce(exact, any_spec, '') AS declared_spec, CAST(coalesce(n, 0) AS BIGINT) AS instances, CAST(1 AS INTEGER) AS paths
  FROM ver LEFT JOIN inst USING (id) LEFT JOIN pins USING (id))"""


def packages(spark, sf):
    """``p_partkey, name, version, spec, id`` of parts read as npm packages."""
    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7)
    spec = F.when(F.col("p_partkey") % 3 == 0, version).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("^"), "p_size", F.lit(".0.0"))).otherwise("")
    rows = table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"), version.alias("version"), spec.alias("spec"))
    return rows.withColumn("id", F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version"))


def instances(spark, sf):
    held = table(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("locator"))
    return held.join(packages(spark, sf), "p_partkey").select("locator", F.col("id").alias("node_id"), F.lit(None).cast("string").alias("parent_locator"))


def _rollup(spark, sf):
    pkg = packages(spark, sf)
    nodes = pkg.select("id", F.lit("npm").alias("ecosystem"), "name", "version", F.lit("resolved").alias("completeness")).distinct()
    edges = pkg.select(F.lit("pkg:generic/app@1").alias("from_id"), F.col("id").alias("to_id"), "spec").distinct()
    paths = nodes.select("id", F.lit(1).alias("paths"))
    return nodes, edges, paths, R.version_rollup(nodes, edges, instances(spark, sf), paths)


@query(f"WITH {PKG_SQL} SELECT node_id, 'npm' AS ecosystem, name, version, state, pinning, declared_spec, instances, paths FROM vr")
def version_rollup(spark, sf):
    return _rollup(spark, sf)[3]


@query(f"""
WITH {PKG_SQL}
SELECT 'npm' AS ecosystem, name, true AS direct, CAST(sum(instances) AS BIGINT) AS instance_count, CAST(least(count(*), 10000) AS INTEGER) AS path_count,
  'resolved' AS worst_completeness, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions
FROM vr GROUP BY name""")
def package_rollup(spark, sf):
    nodes, edges, paths, versions = _rollup(spark, sf)
    roots = spark.createDataFrame([("pkg:generic/app@1",)], "id string")
    return R.package_rollup(nodes, edges, versions, paths, roots).withColumn("versions", F.array_join("versions", ","))


@query(f"WITH {PKG_SQL} SELECT pinning, CAST(count(*) AS BIGINT) AS n FROM vr GROUP BY pinning")
def pinning_counts(spark, sf):
    return R.pinning_counts(_rollup(spark, sf)[3])


@query("""
SELECT l_linenumber, spec, CASE WHEN spec LIKE '=%' OR spec LIKE '1%' THEN 'pinned' WHEN held > 0 THEN 'locked' ELSE 'floating' END AS pinning FROM (
  SELECT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '=1.2.' || l_linenumber WHEN 1 THEN '^1.2.' || l_linenumber ELSE '>=1.' || l_linenumber END AS spec,
    count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05) * (l_linenumber % 2) AS held FROM lineitem GROUP BY l_linenumber)""")
def pinning_class(spark, sf):
    n = F.col("l_linenumber")
    spec = F.when(n % 3 == 0, F.concat(F.lit("=1.2."), n)).when(n % 3 == 1, F.concat(F.lit("^1.2."), n)).otherwise(F.concat(F.lit(">=1."), n))
    held = F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)) * (n % 2)
    rows = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(held.alias("held")).withColumns({"spec": spec, "ecosystem": F.lit("npm")})
    rows = V.with_compiled(rows)
    pinning = F.when(V.is_exact(F.col("compiled")), "pinned").when(F.col("held") > 0, "locked").otherwise("floating")
    return rows.select("l_linenumber", "spec", pinning.alias("pinning"))


@query("""
WITH s AS (SELECT p_type, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 50 AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY p_type)
SELECT p_type AS name, CASE WHEN n > 0 THEN 'installed' WHEN (SELECT sum(n) FROM s) > 0 THEN 'possible' ELSE 'unknown' END AS state FROM s""")
def install_state(spark, sf):
    from plumbline.functions.scalars import install_state as state

    shipped = table(spark, sf, "lineitem").where("l_quantity >= 50 AND l_shipdate >= timestamp_ntz'1995-01-01'").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("one"))
    rows = table(spark, sf, "part").select("p_partkey", "p_type").join(shipped, "p_partkey", "left").groupBy("p_type").agg(F.count("one").alias("n"))
    every = rows.agg((F.sum("n") > 0).alias("has"))
    return rows.join(F.broadcast(every)).select(F.col("p_type").alias("name"), state(F.col("n"), F.col("has")).alias("state"))


@query("""
SELECT 'npm' AS ecosystem, p_brand || '/' || p_size AS name, CAST(min(p_partkey) AS VARCHAR) AS version FROM part
GROUP BY p_brand, p_size HAVING count(DISTINCT p_partkey) = 1""")
def pins_unambiguous(spark, sf):
    from plumbline.functions.purl import purl

    rows = table(spark, sf, "part").select(purl(F.lit("npm"), F.concat_ws("/", "p_brand", "p_size"), F.col("p_partkey").cast("string")).alias("node_id"))
    return R.pins(rows)


REG_SQL = """reg AS (SELECT DISTINCT p_brand AS name, p_size AS a, p_partkey % 10 AS b, p_partkey % 7 AS c FROM part),
req AS (SELECT p_brand AS name, min(p_size) + 1 AS m FROM part GROUP BY p_brand),
met AS (SELECT reg.name, '^' || m || '.2.0' AS spec, a || '.' || b || '.' || c AS version, row_number() OVER (PARTITION BY reg.name ORDER BY a DESC, b DESC, c DESC) AS place
  FROM reg JOIN req ON req.name = reg.name AND a = m AND (b > 2 OR b = 2))"""


def _registry(spark, sf):
    part = table(spark, sf, "part")
    reg = part.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 7).alias("version"), F.lit(None).cast("timestamp").alias("published_at")).distinct()
    req = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("m")).select(F.lit("npm").alias("ecosystem"), "name", F.concat(F.lit("^"), F.col("m") + 1, F.lit(".2.0")).alias("spec"))
    return req, reg


@query(f"WITH {REG_SQL} SELECT name, spec, version FROM met WHERE place = 1")
def range_enumerate_latest(spark, sf):
    return E.enumerate_versions(*_registry(spark, sf), mode="will").select("name", "spec", "version")


@query(f"WITH {REG_SQL} SELECT name, spec, version, CAST(place AS INTEGER) AS place FROM met WHERE place <= 25")
def range_enumerate_cap(spark, sf):
    return E.enumerate_versions(*_registry(spark, sf), mode="can", most=25).select("name", "spec", "version", "place")


@query("""
SELECT name, version FROM (
  SELECT 'b' || p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, min(l_shipdate) AS first_at FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_partkey)
WHERE first_at IS NULL OR first_at <= TIMESTAMP '1995-02-27'""")
def asof_versions(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("published_at"))
    reg = table(spark, sf, "part").join(ship, "p_partkey", "left").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("b"), "p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"), "published_at")
    return E.as_of(reg, F.expr("timestamp_ntz'1995-02-27'")).where("NOT undated").select("name", "version")


CASES = {
    "cargo_table": ("cargo", [
        ("1.2", "1.9.0", True), ("1.2", "2.0.0", False), ("0.3", "0.4.0", False), ("=1.2.3", "1.2.3", True), ("=1.2.3", "1.2.4", False), ("~1.2", "1.2.8", True), ("1.*", "1.7.3", True),
        ("*", "9.9.9", True), (">=1, <1.5", "1.4.9", True), ("1.0.0", "1.1.0-alpha", False), ("1.0.0-alpha", "1.0.0-beta", True),
    ]),
    "go_table": ("golang", [
        ("v1.2.0", "v1.3.0", True), ("v1.2.0", "v1.1.9", False), ("v2.0.0+incompatible", "v2.0.0", True), ("v0.0.0-20200101000000-abcdefabcdef", "v0.0.0-20210101000000-abcdefabcdef", True),
    ]),
    "terraform_table": ("terraform", [
        ("~> 3.2", "3.9.0", True), ("~> 3.2", "4.0.0", False), ("~> 3.2.1", "3.2.9", True), ("~> 3.2.1", "3.3.0", False), (">= 1.0, != 1.2.0", "1.2.0", False), ("= 1.5.7", "1.5.7", True), ("1.5.7", "1.5.8", False),
    ]),
}


def _conformance(name: str, ecosystem: str, cases: list[tuple[str, str, bool]]) -> None:
    values = ", ".join("('%s', '%s', %s)" % (s, v, str(ok).lower()) for s, v, ok in cases)

    @query(f"SELECT * FROM (VALUES {values}) AS t(spec, version, satisfied)", name=name)
    def run(spark, sf):
        rows = spark.createDataFrame([(ecosystem, s, v) for s, v, _ in cases], "ecosystem string, spec string, version string")
        rows = V.with_compiled(rows).withColumn("parsed", V.version_columns(F.col("ecosystem"), F.col("version")))
        return rows.select("spec", "version", V.satisfies(F.col("parsed"), F.col("compiled")).alias("satisfied"))


for _name, (_eco, _cases) in CASES.items():
    _conformance(_name, _eco, _cases)

#: The conformance corpora of FIXTURES A.
_CORPORA = {name: json.loads((Path(__file__).parent / "corpora" / f"{name}.json").read_text(encoding="utf-8")) for name in ("node-semver", "pep440-oracle")}
NPM_CORPUS = [(s, v, True) for s, v in _CORPORA["node-semver"]["range_include"]] + [(s, v, False) for s, v in _CORPORA["node-semver"]["range_exclude"]]
PEP440_CORPUS = [(s, v, ok) for v, s, ok in _CORPORA["pep440-oracle"]["satisfies"]]
COMPARED = {
    "npm_comparisons": ("npm", [(a, b, 1) for a, b in _CORPORA["node-semver"]["comparisons"]]),
    "pep440_comparisons": ("pypi", _CORPORA["pep440-oracle"]["compare"]),
}


def _text(s: str) -> str:
    return "'%s'" % s.replace("'", "''")


def _corpus(name: str, ecosystem: str, cases: list[tuple[str, str, bool]]) -> None:
    """What cannot be parsed does not satisfy."""
    values = ", ".join(f"({_text(s)}, {_text(v)}, {str(ok).lower()})" for s, v, ok in cases)

    @query(f"SELECT * FROM (VALUES {values}) AS t(spec, version, satisfied)", name=name)
    def run(spark, sf):
        rows = spark.createDataFrame([(ecosystem, s, v) for s, v, _ in cases], "ecosystem string, spec string, version string")
        rows = V.with_compiled(rows).withColumn("parsed", V.version_columns(F.col("ecosystem"), F.col("version")))
        return rows.select("spec", "version", F.coalesce(V.satisfies(F.col("parsed"), F.col("compiled")), F.lit(False)).alias("satisfied"))


def _compared(name: str, ecosystem: str, cases: list[tuple[str, str, int]]) -> None:
    values = ", ".join(f"({_text(a)}, {_text(b)}, {sign})" for a, b, sign in cases)

    @query(f"SELECT a, b, CAST(sign AS INTEGER) AS sign FROM (VALUES {values}) AS t(a, b, sign)", name=name)
    def run(spark, sf):
        rows = spark.createDataFrame([(ecosystem, a, b) for a, b, _ in cases], "ecosystem string, a string, b string")
        x, y = (V.version_columns(F.col("ecosystem"), F.col(c))["key"] for c in "ab")
        return rows.select("a", "b", F.when(x < y, -1).when(x == y, 0).when(x > y, 1).alias("sign"))


_corpus("npm_conformance_whole", "npm", NPM_CORPUS)
_corpus("pep440_conformance_whole", "pypi", PEP440_CORPUS)
for _name, (_eco, _cases) in COMPARED.items():
    _compared(_name, _eco, _cases)

POETRY = [
    ("^1.2.3", ">=1.2.3,<2.0.0"), ("^0.2", ">=0.2,<0.3.0"), ("~1.2", ">=1.2,<1.3.0"), ("~1", ">=1,<2.0.0"), ("1.4.*", ">=1.4,<1.5.0"), ("1.2.3", "==1.2.3"),
    (">=1.0 <2.0", ">=1.0,<2.0"), ("*", ""), ("~=1.4", "~=1.4"), ("^1 || ^2", None),
]


@query("SELECT * FROM (VALUES %s) AS t(spec, pep440)" % ", ".join("('%s', %s)" % (s, "NULL" if p is None else f"'{p}'") for s, p in POETRY))
def poetry_translate(spark, sf):
    return V.poetry_translated(spark.createDataFrame([(s,) for s, _ in POETRY], "spec string"))


@query("""
SELECT name, path_count FROM (SELECT p_brand AS name, CAST(least(count(*), 10000) AS INTEGER) AS path_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand)
ORDER BY path_count DESC, name LIMIT 10 OFFSET 5""")
def packages_page(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand").join(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
    rows = rows.groupBy(F.col("p_brand").alias("name")).agg(F.least(F.count(F.lit(1)), F.lit(10_000)).cast("int").alias("path_count")).withColumn("ecosystem", F.lit("npm"))
    return O.packages_page(rows, limit=10, offset=5).select("name", "path_count")
