"""Fleet tables: nations as repositories, their customers as packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import fleet as FL
from plumbline.plans.base import query, table

FLEET_SQL = """e AS (
  SELECT c_nationkey AS run_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'direct' ELSE 'indirect' END AS reach,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'manifest' WHEN 'MACHINERY' THEN 'ci' ELSE '' END AS surface,
    count(*) AS checked, count(*) FILTER (WHERE c_acctbal > 9000) AS affected, count(*) FILTER (WHERE c_custkey % 701 = 0) AS malicious,
    count(*) FILTER (WHERE c_acctbal > 9800) AS critical, count(*) FILTER (WHERE c_acctbal > 9400 AND c_acctbal <= 9800) AS high, count(*) FILTER (WHERE c_acctbal > 9000 AND c_acctbal <= 9400) AS other
  FROM customer GROUP BY ALL)"""


def exposure(spark, sf):
    c, n = table(spark, sf, "customer"), F.count_if
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    surface = F.when(segment == "BUILDING", "manifest").when(segment == "MACHINERY", "ci").otherwise("")
    return c.groupBy(F.col("c_nationkey").alias("run_id"), F.when(surface == "", "indirect").otherwise("direct").alias("reach"), surface.alias("surface")).agg(
        F.count(F.lit(1)).alias("checked"), n(balance > 9000).alias("affected"), n(F.col("c_custkey") % 701 == 0).alias("malicious"), n(balance > 9800).alias("critical"),
        n((balance > 9400) & (balance <= 9800)).alias("high"), n((balance > 9000) & (balance <= 9400)).alias("other"),
    )


@query(f"""
WITH {FLEET_SQL}
SELECT reach, surface, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(affected) AS BIGINT) AS affected, CAST(sum(malicious) AS BIGINT) AS malicious, CAST(sum(critical) AS BIGINT) AS critical,
  CAST(sum(high) AS BIGINT) AS high, CAST(sum(other) AS BIGINT) AS other, CAST(count(*) FILTER (WHERE affected > 0) AS BIGINT) AS repos_hit, sum(affected)::DOUBLE / sum(checked) AS rate
FROM e GROUP BY reach, surface""")
def fleet_reach(spark, sf):
    return FL.exposure_totals(exposure(spark, sf))


@query(f"""
WITH {FLEET_SQL}, t AS (SELECT reach, sum(affected)::DOUBLE / sum(checked) AS rate FROM e GROUP BY reach)
SELECT d.rate AS direct_rate, i.rate AS inherited_rate, d.rate / i.rate AS ratio FROM t d, t i WHERE d.reach = 'direct' AND i.reach = 'indirect'""")
def fleet_reach_ratio(spark, sf):
    return FL.reach_ratio(exposure(spark, sf))


@query(f"""
WITH {FLEET_SQL}
SELECT run_id, CAST(sum(checked) FILTER (WHERE reach = 'direct') AS BIGINT) AS declared, CAST(sum(checked) FILTER (WHERE reach = 'indirect') AS BIGINT) AS inherited,
  sum(checked) FILTER (WHERE reach = 'indirect')::DOUBLE / sum(checked) FILTER (WHERE reach = 'direct') AS multiplier FROM e GROUP BY run_id""")
def fleet_leverage(spark, sf):
    return FL.leverage(exposure(spark, sf))


@query(f"""
WITH {FLEET_SQL}, r AS (SELECT run_id, sum(checked) AS checked, sum(affected) AS affected, sum(malicious) AS malicious, sum(critical) AS critical, sum(high) AS high FROM e WHERE reach = 'direct' GROUP BY run_id)
SELECT run_id, CAST(affected AS BIGINT) AS affected, CAST(malicious AS BIGINT) AS malicious, CAST(critical AS BIGINT) AS critical, affected::DOUBLE / checked AS rate FROM r WHERE affected > 0
ORDER BY malicious DESC, critical DESC, affected::DOUBLE / checked DESC, run_id LIMIT 10""")
def fleet_at_risk(spark, sf):
    return FL.at_risk(exposure(spark, sf), limit=10).select("run_id", "affected", "malicious", "critical", "rate")


@query("""
WITH p AS (SELECT c_nationkey AS run_id, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > c_nationkey * 300) AS f, count(*) AS t FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN f = 0 THEN 'none' WHEN f < 0.25 * t THEN 'under 25%' WHEN f < 0.5 * t THEN '25-50%' WHEN f < 0.75 * t THEN '50-75%' ELSE '75% or more' END AS band FROM p WHERE t >= 10)
SELECT band, CAST(count(*) AS BIGINT) AS repos FROM b GROUP BY band""")
def hygiene_bands(spark, sf):
    floating = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > F.col("c_nationkey") * 300)
    rows = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("run_id"), F.when(floating, "floating").otherwise("locked").alias("pinning")).agg(F.count(F.lit(1)).alias("n"))
    return FL.hygiene_bands(rows)


@query("""
SELECT c_mktsegment AS segment, median FROM (
  SELECT c_mktsegment, c_acctbal AS median, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE r = n // 2""")
def population_medians(spark, sf):
    return FL.upper_medians(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal"), ["segment"], "c_acctbal")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['active', 'growing'] WHEN c_custkey % 3 = 1 THEN ['active'] ELSE [] END AS pops, true AS scanned, c_acctbal > 0 AS resolved, c_acctbal > 5000 AS graded FROM customer),
p AS (SELECT *, unnest(list_concat(['all'], pops)) AS population FROM r),
c AS (SELECT population, count(*) FILTER (WHERE scanned) AS scanned, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE graded) AS graded FROM p GROUP BY population)
SELECT population, stage, CAST(repos AS BIGINT) AS repos FROM (UNPIVOT c ON scanned, resolved, graded INTO NAME stage VALUE repos)""")
def fleet_funnel(spark, sf):
    third = F.col("c_custkey") % 3
    pops = F.when(third == 0, F.array(F.lit("active"), F.lit("growing"))).when(third == 1, F.array(F.lit("active"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "customer").withColumn("population", pops)
    return FL.funnel(rows, {"scanned": F.lit(True), "resolved": F.col("c_acctbal") > 0, "graded": F.col("c_acctbal") > 5000})


@query("""
SELECT what, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE NOT fixed) AS BIGINT) AS moving FROM (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'action' ELSE 'image' END AS what, p_partkey % 5 = 0 AS fixed FROM part) GROUP BY what""")
def beyond_manifest(spark, sf):
    even, fixed = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 5 == 0
    id_ = F.concat(F.when(even, "pkg:github/o/r").otherwise("pkg:oci/i"), F.col("p_partkey"))
    version = F.when(even & fixed, F.repeat(F.lit("a"), F.lit(40))).when(fixed, "sha256:00").otherwise("v1")
    return FL.beyond_manifest(table(spark, sf, "part").select(id_.alias("id"), version.alias("version")))


@query("""
WITH p AS (SELECT o_custkey % 100 AS run_id, 'd' || (o_orderkey % 30) || '@' || o_orderpriority AS direct, CAST(o_orderkey % 9 AS BIGINT) AS affected FROM orders WHERE o_orderstatus = 'P')
SELECT 'd' || split_part(substr(direct, 2), '@', 1) AS name, CAST(count(*) AS BIGINT) AS repos, CAST(sum(affected) AS BIGINT) AS affected FROM p GROUP BY 1""")
def fleet_introducers(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        (F.col("o_custkey") % 100).alias("run_id"), F.concat(F.lit("d"), F.col("o_orderkey") % 30, F.lit("@"), "o_orderpriority").alias("direct"), (F.col("o_orderkey") % 9).alias("affected")
    )
    return FL.introducers(rows)


@query("""
SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS resolved, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS declared,
  CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS opaque, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'F')), ',') AS bounds_hit FROM orders""")
def json_document_summary(spark, sf):
    from plumbline.sources.emit import summary

    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "declared").otherwise("opaque")
    nodes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.alias("completeness"), F.when(status != "resolved", F.col("o_orderpriority")).alias("reason"))
    return summary(nodes).select("nodes", "resolved", "declared", "opaque", F.array_join("bounds_hit", ",").alias("bounds_hit"))
