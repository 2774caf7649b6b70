"""Graph queries on a layered graph made of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.plans.base import query, table

EDGES_SQL = """g_edges AS (
  SELECT 'root' AS from_id, 'r:' || r_regionkey AS to_id FROM region UNION
  SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation UNION
  SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION
  SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders UNION
  SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem UNION
  SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem)"""


def edges(spark: SparkSession, sf: str, levels: int = 6) -> DataFrame:
    """The first ``levels`` of root, region, nation, customer, order, part, supplier."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    parts = [
        ("region", F.lit("root"), name("r:", "r_regionkey")),
        ("nation", name("r:", "n_regionkey"), name("n:", "n_nationkey")),
        ("customer", name("n:", "c_nationkey"), name("c:", "c_custkey")),
        ("orders", name("c:", "o_custkey"), name("o:", "o_orderkey")),
        ("lineitem", name("o:", "l_orderkey"), name("p:", "l_partkey")),
        ("lineitem", name("p:", "l_partkey"), name("s:", "l_suppkey")),
    ]
    out = None
    for t, a, b in parts[:levels]:
        part = table(spark, sf, t).select(a.alias("from_id"), b.alias("to_id")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT l_linestatus AS kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT l_orderkey, l_partkey, l_linestatus, l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN 'dev' ELSE 'prod' END AS scope FROM lineitem)
GROUP BY l_linestatus""")
def edge_dedupe(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("spec"),
        F.when(F.col("l_linenumber") % 2 == 0, "dev").otherwise("prod").alias("scope"),
    )
    return G.dedupe_edges(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT id, completeness, ord FROM (
  SELECT o_custkey AS id, c AS completeness, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY r DESC, o_orderkey) AS rn FROM (
    SELECT *, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'inferred' ELSE 'declared' END AS c,
      CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS r FROM orders))
WHERE rn = 1""")
def node_upsert_rank(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "inferred").otherwise("declared")
    return G.upsert_nodes(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), status.alias("completeness"), F.col("o_orderkey").alias("ord")))


@query(f"WITH {EDGES_SQL} SELECT from_id, to_id FROM g_edges WHERE to_id = 's:1'")
def inbound_edges(spark, sf):
    return G.inbound(edges(spark, sf).withColumns({"kind": F.lit("depends_on"), "spec": F.lit(""), "scope": F.lit("prod")}), "s:1").select("from_id", "to_id")


@query(f"WITH {EDGES_SQL} SELECT to_id FROM g_edges WHERE from_id = 'n:1'")
def direct_children(spark, sf):
    return edges(spark, sf).where("from_id = 'n:1'").select("to_id")


@query(f"""
WITH {EDGES_SQL},
l1 AS (SELECT to_id AS id FROM g_edges WHERE from_id = 'root'),
l2 AS (SELECT DISTINCT to_id AS id FROM g_edges JOIN l1 ON from_id = id),
l3 AS (SELECT DISTINCT to_id AS id FROM g_edges JOIN l2 ON from_id = id)
SELECT 'root' AS id, CAST(0 AS INTEGER) AS depth, CAST(NULL AS VARCHAR) AS reason
UNION ALL SELECT id, 1, NULL FROM l1 UNION ALL SELECT id, 2, NULL FROM l2
UNION ALL SELECT id, 3, CASE WHEN id IN (SELECT from_id FROM g_edges) THEN 'bound:depth' END FROM l3""")
def closure_bounded_depth(spark, sf):
    return G.closure(edges(spark, sf, 4), spark.createDataFrame([("root",)], "id string"), max_depth=3)


@query("""
WITH RECURSIVE e AS (
  SELECT 'n:' || s_nationkey AS from_id, 's:' || s_suppkey AS to_id FROM supplier
  UNION SELECT 's:' || s_suppkey, 'n:' || CAST(s_suppkey * 7 % 25 AS BIGINT) FROM supplier),
walk AS (
  SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS id FROM nation
  UNION SELECT walk.source, e.to_id FROM walk JOIN e ON walk.id = e.from_id)
SELECT source, id FROM walk""")
def reachable_cyclic(spark, sf):
    s = table(spark, sf, "supplier")
    nation, supplier = F.concat(F.lit("n:"), F.col("s_nationkey")), F.concat(F.lit("s:"), F.col("s_suppkey"))
    there = s.select(nation.alias("from_id"), supplier.alias("to_id"))
    back = s.select(supplier.alias("from_id"), F.concat(F.lit("n:"), F.col("s_suppkey") * 7 % 25).alias("to_id"))
    start = table(spark, sf, "nation").select(F.concat(F.lit("r:"), F.col("n_regionkey")).alias("source"), F.concat(F.lit("n:"), F.col("n_nationkey")).alias("id"))
    return G.reachable(there.unionByName(back), start)


def _paths(spark, sf, levels):
    e = edges(spark, sf, levels)
    ids = e.select(F.col("from_id").alias("id")).union(e.select(F.col("to_id").alias("id"))).distinct()
    # the layers have no cycles, so every node is its own component
    return G.path_counts(ids, e, "root", components=ids.withColumn("component", F.col("id")))


@query("""
SELECT 'p:' || l_partkey AS id, CAST(least(count(DISTINCT l_orderkey), 10000) AS INTEGER) AS paths
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_partkey""")
def path_count_dag(spark, sf):
    return _paths(spark, sf, 5).where("id LIKE 'p:%'")


@query("""
WITH p AS (SELECT l_partkey, least(count(DISTINCT l_orderkey), 10000) AS paths FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_partkey)
SELECT 's:' || l_suppkey AS id, CAST(least(sum(paths), 10000) AS INTEGER) AS paths
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN p USING (l_partkey) GROUP BY l_suppkey""")
def path_count_saturated(spark, sf):
    return _paths(spark, sf, 6).where("id LIKE 's:%'")


TRADE_SQL = """t AS (
  SELECT DISTINCT 'n:' || s_nationkey AS from_id, 'n:' || c_nationkey AS to_id
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE l_quantity >= 49.5 AND l_discount >= 0.1 AND s_nationkey <> c_nationkey),
reach AS (SELECT from_id, to_id FROM t UNION SELECT reach.from_id, t.to_id FROM reach JOIN t ON reach.to_id = t.from_id),
ids AS (SELECT from_id AS id FROM t UNION SELECT to_id FROM t),
comp AS (
  SELECT id, least(id, coalesce((SELECT min(a.to_id) FROM reach a JOIN reach b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.from_id = ids.id), id)) AS component FROM ids)"""


def trade(spark, sf):
    """Nations that sell to nations, in a few large discounted orders."""
    rows = table(spark, sf, "lineitem").where("l_quantity >= 49.5 AND l_discount >= 0.1").select("l_orderkey", "l_suppkey")
    rows = rows.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    rows = rows.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").where("s_nationkey <> c_nationkey")
    return rows.select(F.concat(F.lit("n:"), "s_nationkey").alias("from_id"), F.concat(F.lit("n:"), "c_nationkey").alias("to_id")).distinct()


def _trade_metrics(spark, sf):
    e = trade(spark, sf)
    first = e.agg(F.min(F.least("from_id", "to_id")).alias("root"))
    return G.run_metrics(e.join(F.broadcast(first)).withColumn("run_id", F.lit("trade")))


@query(f"WITH RECURSIVE {TRADE_SQL} SELECT id, component FROM comp")
def scc_nation_trade(spark, sf):
    return _trade_metrics(spark, sf).select("id", "component")


@query(f"""
WITH RECURSIVE {TRADE_SQL},
ce AS (SELECT DISTINCT f.component AS f, g.component AS t FROM t JOIN comp f ON f.id = t.from_id JOIN comp g ON g.id = t.to_id WHERE f.component <> g.component),
walk AS (SELECT component AS c FROM comp WHERE id = (SELECT min(id) FROM ids) UNION ALL SELECT ce.t FROM walk JOIN ce ON ce.f = walk.c),
n AS (SELECT c, least(count(*), 10000) AS paths FROM walk GROUP BY c)
SELECT id, CAST(coalesce(paths, 0) AS INTEGER) AS paths FROM comp LEFT JOIN n ON n.c = comp.component""")
def condensed_path_count(spark, sf):
    return _trade_metrics(spark, sf).select("id", "paths")


@query(f"""
WITH {EDGES_SQL},
c AS (SELECT ['root', a.to_id, b.to_id, c.to_id, d.to_id, e.to_id, 's:1'] AS path
  FROM g_edges f JOIN g_edges e ON e.to_id = f.from_id JOIN g_edges d ON d.to_id = e.from_id JOIN g_edges c ON c.to_id = d.from_id JOIN g_edges b ON b.to_id = c.from_id JOIN g_edges a ON a.to_id = b.from_id
  WHERE f.to_id = 's:1' AND a.from_id = 'root')
SELECT array_to_string(path, ' > ') AS path, CAST(6 AS INTEGER) AS length FROM c ORDER BY c.path LIMIT 10""")
def paths_to_k(spark, sf):
    return G.paths_to(edges(spark, sf), "root", "s:1", 10).select(F.array_join("path", " > ").alias("path"), "length")


INTRODUCED_SQL = """pairs AS (
  SELECT DISTINCT 'n:' || c_nationkey AS direct, 'p:' || l_partkey AS id
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size >= 49)"""


def introduced(spark, sf):
    """Large parts by the nations whose customers order them."""
    direct = table(spark, sf, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"))
    hit = table(spark, sf, "part").where("p_size >= 49").select(F.concat(F.lit("p:"), "p_partkey").alias("id"))
    lines = table(spark, sf, "lineitem")
    big = lines.select(F.concat(F.lit("o:"), "l_orderkey").alias("from_id"), F.concat(F.lit("p:"), "l_partkey").alias("to_id"))
    e = edges(spark, sf, 4).unionByName(big)
    # only what leads to a hit matters below the direct dependencies
    last = e.where("to_id LIKE 'p:%'").join(hit.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
    return G.attribution(direct, hit, e.where("to_id NOT LIKE 'p:%'").unionByName(last))


def _greedy_sql(steps: int, pairs: str = INTRODUCED_SQL) -> str:
    parts = [pairs]
    for i in range(1, steps + 1):
        parts.append(f"s{i} AS (SELECT direct, count(*) AS gain FROM pairs WHERE id NOT IN (SELECT id FROM d{i - 1}) GROUP BY direct ORDER BY gain DESC, direct LIMIT 1)" if i > 1 else "s1 AS (SELECT direct, count(*) AS gain FROM pairs GROUP BY direct ORDER BY gain DESC, direct LIMIT 1)")
        parts.append(f"d{i} AS (" + (f"SELECT id FROM d{i - 1} UNION " if i > 1 else "") + f"SELECT id FROM pairs JOIN s{i} USING (direct))")
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, direct, gain FROM s{i}" for i in range(1, steps + 1))
    return f"WITH {', '.join(parts)}, a AS (SELECT direct, count(*) AS affected FROM pairs GROUP BY direct) SELECT step, direct, CAST(affected AS BIGINT) AS affected, CAST(gain AS BIGINT) AS gain FROM ({rows}) JOIN a USING (direct)"


@query(f"""
WITH {INTRODUCED_SQL}, own AS (SELECT id, count(*) AS k FROM pairs GROUP BY id)
SELECT direct, CAST(count(*) AS BIGINT) AS affected, CAST(count(*) FILTER (WHERE k = 1) AS BIGINT) AS exclusive FROM pairs JOIN own USING (id) GROUP BY direct""")
def introducers_whole(spark, sf):
    return G.introducers(introduced(spark, sf))


@query(f"""
WITH {INTRODUCED_SQL}, own AS (SELECT id, count(*) AS k, min(direct) AS direct FROM pairs GROUP BY id)
SELECT direct, id FROM own WHERE k = 1""")
def introducers_exclusive_whole(spark, sf):
    return introduced(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("direct").alias("direct")).where("k = 1").select("direct", "id")


@query(_greedy_sql(5))
def greedy_plan_whole(spark, sf):
    return G.greedy_plan(introduced(spark, sf), 5)


@query(f"""
WITH {EDGES_SQL},
m AS (SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION SELECT 'c:' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_acctbal > 0),
i AS (SELECT from_id, to_id FROM g_edges WHERE from_id IN (SELECT id FROM m) AND to_id IN (SELECT id FROM m))
SELECT from_id, to_id, 'depends_on' AS kind FROM i
UNION ALL SELECT 'unit', id, 'depends_on' FROM m WHERE id NOT IN (SELECT to_id FROM i)""")
def induced_subgraph(spark, sf):
    n, c = table(spark, sf, "nation").where("n_regionkey = 1"), table(spark, sf, "customer").where("c_acctbal > 0")
    members = n.select(F.concat(F.lit("n:"), "n_nationkey").alias("id")).union(
        c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi").select(F.concat(F.lit("c:"), "c_custkey").alias("id"))
    )
    return G.induced_subgraph(edges(spark, sf, 3).withColumn("kind", F.lit("depends_on")), members, "unit").select("from_id", "to_id", "kind")


@query("""
SELECT unit, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'app' || (c_custkey % 5) AS unit, 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT 'n' || c_nationkey, 'c:' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey < 10
  UNION SELECT 'n' || n_nationkey, 'pkg:generic/buildfile/workflow@' || n_nationkey || '#n' || n_nationkey FROM nation WHERE n_nationkey < 10
  UNION SELECT '_repo', 'c:' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey >= 10)
GROUP BY unit""")
def split_units(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), "c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").where("n_nationkey < 10")
    file = lambda k: F.concat(F.lit("pkg:generic/buildfile/workflow@"), k, F.lit("#n"), k)
    nodes = c.select("id").union(n.select(file(F.col("n_nationkey"))))
    built = c.where("c_nationkey < 10").select(file(F.col("c_nationkey")).alias("from_id"), F.col("id").alias("to_id"))
    placed = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("app"), F.col("c_custkey") % 5, F.lit("#"), "c_custkey").alias("locator"), F.col("id").alias("node_id"))
    return G.split_units(nodes, built, placed).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
