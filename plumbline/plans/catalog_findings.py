"""Advisory, posture, control and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import controls as C
from plumbline.operators import findings as FI
from plumbline.operators import posture as PO
from plumbline.operators import score as SC
from plumbline.plans.base import query, table

# parts as package versions: findings by price and size, surfaces by return flag
EXPOSE_SQL = """target AS (SELECT 'pkg:npm/p' || p_partkey AS node_id FROM part),
fnd AS (
  SELECT 'pkg:npm/p' || p_partkey AS node_id, 'A' || p_partkey AS osv_id, CASE WHEN p_size >= 48 THEN 'CRITICAL' WHEN p_size >= 44 THEN 'HIGH' ELSE 'MODERATE' END AS label FROM part WHERE p_size >= 40
  UNION ALL SELECT 'pkg:npm/p' || p_partkey, 'MAL-' || p_partkey, 'MALICIOUS' FROM part WHERE p_partkey % 97 = 0),
named AS (SELECT DISTINCT 'pkg:npm/p' || l_partkey AS node_id, CASE l_returnflag WHEN 'A' THEN 'manifest' WHEN 'N' THEN 'ci' ELSE 'dockerfile' END AS surface FROM lineitem WHERE l_quantity >= 49)"""


def exposed(spark, sf):
    part = table(spark, sf, "part")
    node = F.concat(F.lit("pkg:npm/p"), "p_partkey")
    none = F.array().cast("array<string>")
    band = F.when(F.col("p_size") >= 48, "CRITICAL").when(F.col("p_size") >= 44, "HIGH").otherwise("MODERATE")
    rated = part.where("p_size >= 40").select(node.alias("node_id"), F.concat(F.lit("A"), "p_partkey").alias("osv_id"), band.alias("severity"))
    bad = part.where("p_partkey % 97 = 0").select(node.alias("node_id"), F.concat(F.lit("MAL-"), "p_partkey").alias("osv_id"), F.lit("").alias("severity"))
    findings = FI.dedupe(rated.union(bad).withColumns({"summary": F.lit("s"), "aliases": none}))
    flag = F.when(F.col("l_returnflag") == "A", "manifest").when(F.col("l_returnflag") == "N", "ci").otherwise("dockerfile")
    named = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("pkg:npm/p"), "l_partkey").alias("id"), flag.alias("surface")).distinct()
    return part.select(node.alias("node_id")), findings, named


@query(f"""
WITH {EXPOSE_SQL},
c AS (SELECT coalesce(surface, '') AS surface, count(*) AS checked FROM target LEFT JOIN named USING (node_id) GROUP BY 1),
h AS (SELECT coalesce(surface, '') AS surface, count(DISTINCT node_id) AS affected, count(*) FILTER (WHERE label = 'MALICIOUS') AS malicious, count(*) FILTER (WHERE label = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE label = 'HIGH') AS high, count(*) FILTER (WHERE label NOT IN ('MALICIOUS', 'CRITICAL', 'HIGH')) AS other FROM fnd LEFT JOIN named USING (node_id) GROUP BY 1)
SELECT CASE WHEN surface = '' THEN 'indirect' ELSE 'direct' END AS reach, surface, CAST(coalesce(checked, 0) AS BIGINT) AS checked, CAST(coalesce(affected, 0) AS BIGINT) AS affected,
  CAST(coalesce(malicious, 0) AS BIGINT) AS malicious, CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(high, 0) AS BIGINT) AS high, CAST(coalesce(other, 0) AS BIGINT) AS other
FROM c FULL JOIN h USING (surface)""")
def exposure_by_surface(spark, sf):
    return FI.exposure(*exposed(spark, sf))


@query(f"WITH {EXPOSE_SQL} SELECT node_id, array_to_string(list_sort(list(DISTINCT surface)), ',') AS surfaces FROM named GROUP BY node_id")
def surfaces_set(spark, sf):
    return FI.surface_sets(exposed(spark, sf)[2]).select(F.col("id").alias("node_id"), F.array_join("surfaces", ",").alias("surfaces"))


ADV_SQL = """adv AS (
  SELECT user_id AS node, event_id, ts AS published, CASE WHEN event_id % 3 = 0 THEN ts + to_hours(CAST(floor(value) AS INTEGER)) END AS withdrawn,
    CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 80 THEN 'HIGH' WHEN value >= 30 THEN 'MODERATE' WHEN value >= 10 THEN 'LOW' ELSE '' END AS severity,
    'E' || event_id AS osv_id, CASE WHEN event_id % 2 = 0 THEN 'CVE-' || (event_id % 20) END AS cve, CASE WHEN event_id % 5 = 0 THEN '' ELSE 's' END AS summary
  FROM events WHERE event_type = 'error')"""


def advisories(spark, sf):
    """Error events as advisories on the user they hit."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    band = F.when(F.col("value") >= 150, "CRITICAL").when(F.col("value") >= 80, "HIGH").when(F.col("value") >= 30, "MODERATE").when(F.col("value") >= 10, "LOW").otherwise("")
    alias = F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("CVE-"), F.col("event_id") % 20))).otherwise(F.array().cast("array<string>"))
    osv = F.concat(F.lit("E"), "event_id")
    withdrawn = F.when(F.col("event_id") % 3 == 0, F.expr("ts + make_dt_interval(0, CAST(floor(value) AS INT))"))
    records = e.select(
        osv.alias("osv_id"), F.col("ts").alias("published"), withdrawn.alias("withdrawn"), band.alias("severity"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("s").alias("summary"), alias.alias("aliases"),
    )
    return e.select(F.col("user_id").alias("node_id"), osv.alias("osv_id")), records


@query(f"""
WITH {ADV_SQL}, k AS (SELECT * FROM adv WHERE published <= TIMESTAMP '2024-01-15' AND (withdrawn IS NULL OR withdrawn > TIMESTAMP '2024-01-15'))
SELECT node AS node_id, osv_id FROM (SELECT *, row_number() OVER (PARTITION BY node, coalesce(cve, osv_id) ORDER BY (severity = '')::INT, (summary = '')::INT, osv_id) AS rn FROM k) WHERE rn = 1""")
def known_at_findings(spark, sf):
    return FI.check(*advisories(spark, sf), known_at=F.expr("timestamp_ntz'2024-01-15'")).select("node_id", "osv_id")


DEDUPED_SQL = f"""{ADV_SQL}, best AS (
  SELECT node AS node_id, osv_id, cve, CASE WHEN severity = '' THEN 'UNKNOWN' ELSE severity END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY node, coalesce(cve, osv_id) ORDER BY (severity = '')::INT, (summary = '')::INT, osv_id) AS rn FROM adv) WHERE rn = 1)"""


@query(f"WITH {DEDUPED_SQL} SELECT node_id, osv_id, cve, label FROM best")
def finding_dedupe(spark, sf):
    return FI.check(*advisories(spark, sf)).select("node_id", "osv_id", "cve", "label")


@query(f"""
WITH {DEDUPED_SQL}
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(CASE label WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 4 WHEN 'LOW' THEN 5 ELSE 6 END AS INTEGER) AS ord FROM best GROUP BY label""")
def severity_histogram(spark, sf):
    return FI.severity_histogram(FI.check(*advisories(spark, sf)))


@query(f"""
WITH {DEDUPED_SQL}
SELECT node_id, CAST(max(CASE label WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END) AS INTEGER) AS worst FROM best GROUP BY node_id""")
def worst_severity_per_node(spark, sf):
    return FI.worst_per_node(FI.check(*advisories(spark, sf)))


@query("""
WITH a AS (SELECT DISTINCT user_id, CAST(event_id % 7 AS VARCHAR) AS id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id, CAST(event_id % 7 AS VARCHAR) AS id FROM events WHERE event_type = 'purchase')
SELECT CAST(count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS BIGINT) AS agreed, CAST(count(*) FILTER (WHERE b.id IS NULL) AS BIGINT) AS osv_only, CAST(count(*) FILTER (WHERE a.id IS NULL) AS BIGINT) AS other_only
FROM a FULL JOIN b USING (user_id, id)""")
def cross_check_full_outer(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("node_id"), (F.col("event_id") % 7).cast("string").alias("osv_id"))
    return FI.cross_check(pick("error"), pick("purchase"))


@query("""
WITH o AS (SELECT DISTINCT l_partkey AS id, 'app' || (l_suppkey % 4) AS owner FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT l_partkey, 'wf' || l_linenumber FROM lineitem WHERE l_tax >= 0.08)
SELECT id, array_to_string(list_sort(list(DISTINCT owner)), ',') AS owners FROM o GROUP BY id""")
def owners_set(spark, sf):
    li = table(spark, sf, "lineitem")
    placed = li.where("l_quantity >= 49").select(F.concat(F.lit("app"), F.col("l_suppkey") % 4, F.lit("#"), "l_orderkey").alias("locator"), F.col("l_partkey").alias("node_id"))
    built = li.where("l_tax >= 0.08").select(F.concat(F.lit("pkg:generic/buildfile/workflow@x#wf"), "l_linenumber").alias("from_id"), F.col("l_partkey").alias("to_id"))
    return FI.node_owners(placed, built).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))


FACT_SQL = """f AS (SELECT event_id AS node_id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'r' || (user_id % 40) END AS repo, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'view'),
proj AS (SELECT 'r' || (user_id % 40) AS project, max(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 5 - 1 AS score FROM events WHERE user_id % 3 > 0 GROUP BY 1)"""


def facts(spark, sf):
    """View events as package facts, users as source repositories."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k BIGINT")["k"]
    repo = F.concat(F.lit("r"), F.col("user_id") % 40)
    facts = e.where("event_type = 'view'").select(
        F.col("event_id").alias("node_id"), F.lit(True).alias("queried"), (k % 10 != 0).alias("known"), (k % 7 == 0).alias("deprecated"), F.lit("").alias("deprecated_reason"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("MIT"))).otherwise(F.array(F.lit("non-standard"))).alias("licenses"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(repo).alias("source_repo"), F.when(k % 2 == 0, "SLSA_ATTESTATION").otherwise("UNVERIFIED_METADATA").alias("provenance"),
    )
    check = F.struct((F.max(k) % 5 - 1).cast("int").alias("score"), F.lit("r").alias("reason"), F.array(F.lit("w")).alias("warnings"))
    projects = e.where("user_id % 3 > 0").groupBy(repo.alias("project_id")).agg(check.alias("c"))
    names = F.array(*[F.lit(r[0]) for r in PO.SCORECARD_RULES])
    return facts, projects.select("project_id", F.lit(True).alias("has_scorecard"), F.map_from_arrays(names, F.array_repeat("c", 7)).alias("checks"))


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{code}', {least})" for _, least, code, _ in PO.SCORECARD_RULES) + ") t(code, least))"


@query(f"WITH {FACT_SQL}, {RULES_SQL} SELECT project AS source_repo, code FROM proj, rules WHERE score >= 0 AND score <= least")
def scorecard_signals(spark, sf):
    return PO.scorecard_signals(facts(spark, sf)[1]).select("source_repo", "code")


@query(f"""
WITH {FACT_SQL}, {RULES_SQL}, known AS (SELECT * FROM f WHERE k % 10 <> 0),
s AS (
  SELECT node_id, repo, 'unlisted' AS code FROM f WHERE k % 10 = 0 UNION ALL SELECT node_id, repo, 'deprecated' FROM known WHERE k % 7 = 0
  UNION ALL SELECT node_id, repo, 'no-license' FROM known WHERE k % 3 = 0 UNION ALL SELECT node_id, repo, 'non-standard-license' FROM known WHERE k % 3 = 2
  UNION ALL SELECT node_id, repo, 'no-source-repo' FROM known WHERE repo = '' UNION ALL SELECT node_id, repo, 'unattested-source' FROM known WHERE repo <> '' AND k % 2 = 1
  UNION ALL SELECT node_id, repo, 'no-scorecard' FROM known WHERE repo <> '' AND repo NOT IN (SELECT project FROM proj)
  UNION ALL SELECT node_id, repo, code FROM known JOIN proj ON project = repo, rules WHERE score >= 0 AND score <= least)
SELECT code, CAST(count(*) AS BIGINT) AS versions, CAST(count(DISTINCT nullif(repo, '')) AS BIGINT) AS projects FROM s GROUP BY code""")
def posture_counts(spark, sf):
    return PO.signal_counts(PO.assess(*facts(spark, sf))).select("code", "versions", "projects")


@query(f"""
WITH c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'declared' ELSE 'opaque' END AS completeness, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE lower(substr(o_orderpriority, 3)) END AS reason FROM orders)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM c WHERE completeness IN ('declared', 'opaque') AND reason <> '' GROUP BY reason""")
def coverage_frontier(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "declared").otherwise("opaque")
    reason = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.lower(F.substring("o_orderpriority", 3, 100)))
    return FI.coverage(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("completeness"), reason.alias("reason")))


@query("""
WITH n AS (SELECT c_nationkey AS run_id, c_custkey % 5 = 0 AS act, c_custkey % 7 = 0 AS skip FROM customer),
t AS (SELECT c_nationkey AS run_id, count(*) AS targets FROM customer WHERE c_acctbal > 3000 GROUP BY 1),
s AS (SELECT run_id, count(*) FILTER (WHERE act) AS action_nodes, count(*) FILTER (WHERE NOT act AND NOT skip) AS package_nodes FROM n GROUP BY 1)
SELECT run_id, CAST(package_nodes + action_nodes AS BIGINT) AS surface, least(1.0, (coalesce(targets, 0) + action_nodes)::DOUBLE / (package_nodes + action_nodes)) AS auditable FROM s LEFT JOIN t USING (run_id)""")
def auditable_share(spark, sf):
    c = table(spark, sf, "customer")
    id_ = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("pkg:github/o/r"), "c_custkey")).otherwise(F.concat(F.lit("pkg:npm/p"), "c_custkey"))
    nodes = c.select(F.col("c_nationkey").alias("run_id"), id_.alias("id"), F.when(F.col("c_custkey") % 7 == 0, "dev-not-installed").alias("reason"), F.lit("resolved").alias("completeness"))
    return FI.auditable(nodes, c.where("c_acctbal > 3000").select(F.col("c_nationkey").alias("run_id"), "c_custkey")).select("run_id", "surface", "auditable")


# one run per nation; counts of its customers stand for the inputs of a score
INPUT_SQL = """i AS (
  SELECT c_nationkey AS run_id, count(*) AS checked, count(*) FILTER (WHERE c_custkey % 701 = 0) AS malicious, count(*) FILTER (WHERE c_acctbal > 9800) AS critical, count(*) FILTER (WHERE c_acctbal > 9000) AS high,
    count(*) FILTER (WHERE c_acctbal > 8000) AS moderate, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS floating, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS pinned,
    count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS locked, c_nationkey % 9 AS controls_missing, count(*) FILTER (WHERE c_acctbal < -500) AS unmaintained, (c_nationkey % 10) / 9.0::DOUBLE AS auditable
  FROM customer GROUP BY c_nationkey),
s AS (
  SELECT *, least(100, CAST(floor(CASE WHEN malicious > 0 THEN 100.0 ELSE least(45.0, 45 * sqrt(least(1.0::DOUBLE, (critical * 10 + high * 3 + moderate)::DOUBLE / checked / 0.35::DOUBLE)))
    + coalesce(20.0 * floating::DOUBLE / nullif(floating + pinned + locked, 0), 0) + controls_missing / 9.0::DOUBLE * 20 + least(15.0::DOUBLE, unmaintained::DOUBLE / checked * 15) END + 0.5) AS INTEGER)) AS score FROM i),
g AS (
  SELECT *, auditable < 0.5 AS suppressed, CASE WHEN auditable < 0.5 THEN NULL WHEN malicious > 0 THEN 'F' WHEN score >= 70 THEN 'F' WHEN score >= 50 THEN 'D' WHEN score >= 35 THEN 'C' WHEN score >= 20 THEN 'B' ELSE 'A' END AS grade FROM s)"""


def scored(spark, sf):
    c, n = table(spark, sf, "customer"), F.count_if
    rows = c.groupBy(F.col("c_nationkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("checked"), n(F.col("c_custkey") % 701 == 0).alias("malicious"), n(F.col("c_acctbal") > 9800).alias("critical"), n(F.col("c_acctbal") > 9000).alias("high"),
        n(F.col("c_acctbal") > 8000).alias("moderate"), n(F.col("c_mktsegment") == "BUILDING").alias("floating"), n(F.col("c_mktsegment") == "MACHINERY").alias("pinned"),
        n(F.col("c_mktsegment") == "HOUSEHOLD").alias("locked"), n(F.col("c_acctbal") < -500).alias("unmaintained"),
    )
    zero = {k: F.lit(0) for k in SC.INPUTS if k not in rows.columns}
    rows = rows.withColumns(zero | {"surface": F.col("checked"), "controls_missing": F.col("run_id") % 9, "controls_total": F.lit(9), "controls_assessable": F.lit(True), "auditable": (F.col("run_id") % 10) / F.lit(9.0)})
    return SC.score(rows)


@query(f"WITH {INPUT_SQL} SELECT run_id, CAST(score AS INTEGER) AS score, suppressed, grade FROM g")
def risk_score(spark, sf):
    return scored(spark, sf).select("run_id", "score", "suppressed", "grade")


@query(f"WITH {INPUT_SQL} SELECT grade, CAST(count(*) AS BIGINT) AS n FROM g WHERE NOT suppressed GROUP BY grade")
def grade_distribution(spark, sf):
    from plumbline.operators.fleet import grades

    return grades(scored(spark, sf))


HEADS = "'trivy','grype','syft','semgrep','bandit','checkov','snyk','cosign'"


def commands(spark, sf):
    """Conversation turns as opaque shell steps: every third runs a tool."""
    c = table(spark, sf, "conversations")
    names = F.split(F.lit("trivy,grype,syft,semgrep,bandit,checkov,snyk,cosign"), ",")
    tool = F.get(names, ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    note = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("sudo CI=1 /usr/bin/"), tool, F.lit(" fs . && echo semgrep"))).otherwise(F.concat(F.lit("echo "), tool))
    source = F.concat(F.lit("f"), F.col("turn"))
    return c.select((F.col("conv_id") % 20).alias("run_id"), F.concat_ws("-", F.lit("pkg:generic/opaque@"), "conv_id", "turn").alias("id"), F.lit("opaque").alias("completeness"), note.alias("note"), source.alias("source"))


TOOL_SQL = "tools AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{t}')" for how, n, k, t, _ in C.TOOLS if how == "command") + ") t(name, kind, tool))"
HEAD_SQL = f"{TOOL_SQL}, h AS (SELECT DISTINCT conv_id % 20 AS run_id, ([{HEADS}])[(conv_id + turn) % 8 + 1] AS name FROM conversations WHERE turn % 3 = 0)"


@query(f"WITH {HEAD_SQL} SELECT run_id, kind, tool FROM h JOIN tools USING (name)")
def controls_headword(spark, sf):
    return C.detect(commands(spark, sf)).select("run_id", "kind", "tool")


@query(f"WITH {HEAD_SQL}, k AS (SELECT unnest([{', '.join(repr(k) for k in C.KINDS)}]) AS kind) SELECT r.run_id, k.kind FROM (SELECT DISTINCT conv_id % 20 AS run_id FROM conversations) r, k WHERE (r.run_id, k.kind) NOT IN (SELECT run_id, kind FROM h JOIN tools USING (name))")
def controls_missing(spark, sf):
    nodes = commands(spark, sf)
    return C.missing(C.detect(nodes), nodes)


@query("""
WITH o AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 50 GROUP BY p_partkey)
SELECT n > 0 AS has_dependencies, CAST(count(*) AS BIGINT) AS components FROM o GROUP BY 1""")
def dependency_presence(spark, sf):
    named = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("d", F.lit(True))
    rows = table(spark, sf, "part").select("p_partkey").join(named, "p_partkey", "left")
    return rows.groupBy(F.coalesce("d", F.lit(False)).alias("has_dependencies")).agg(F.count(F.lit(1)).alias("components"))


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT doc_id, line, regexp_matches(line, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS ok FROM l WHERE line <> '' AND line NOT LIKE '#%'),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM c GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS candidates, CAST(good AS BIGINT) AS parsed, n >= 4 AND good * 2 < n AS rejected FROM g""")
def requirements_lines(spark, sf):
    from plumbline.sources.extractors import requirement_gate

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    return requirement_gate(docs, r"^[A-Za-z0-9][A-Za-z0-9._-]*$").withColumnRenamed("file", "doc_id")


@query("""
SELECT event_id, k.unnest AS name, CAST(json_extract_string(props, '$.' || k.unnest) AS VARCHAR) AS spec FROM events, unnest(json_keys(props)) k""")
def json_manifest_explode(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "spec"))
