"""The closure of a repository: requirements expanded level by level.

Each level is one set of joins over the frontier of distinct requirements;
what was expanded before is left out, lineage is cut once a level, and every
bound that stops the walk leaves a named reason on the nodes it stopped. The bound
on nodes holds for each node: a level that would pass it is cut inside.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import purl as P
from plumbline.functions.versions import COMPILERS
from plumbline.operators import enumerate as E
from plumbline.operators.graph import upsert_nodes
from plumbline.operators.workspace import by_key, cut

NODE = "id string, ecosystem string, name string, version string, completeness string, reason string, published_at timestamp, resolved_ref string, source string, note string, ord long"
#: Most rows of a level that are sent to every part of a registry table.
FEW = 50_000
EDGE = "from_id string, to_id string, kind string, spec string, scope string, origin string"


@dataclass(frozen=True)
class Bounds:
    max_depth: int = 32
    max_nodes: int | None = 50_000  # None: the whole closure
    versions_per_range: int = 25
    mode: str = "will"  # or can
    as_of: datetime | None = None
    seconds: float | None = None


@dataclass
class Closure:
    nodes: DataFrame
    edges: DataFrame
    depth: int
    bounds_hit: list[str] = field(default_factory=list)


def _nodes(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in NODE.split(", "))])


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select(*[c.split()[0] for c in EDGE.split(", ")])


def seed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known nodes, concrete edges and open requirements of extractor output. A
    target without a version is a requirement; its edge kind is carried."""
    bare = P.is_package("to_id") & (P.purl_version("to_id") == "") & P.purl_type("to_id").isin(*COMPILERS)
    frontier = nodes.where("reason = 'poetry-alternation'").select(F.col("id").alias("to_id"))
    open_ = edges.where(bare).join(frontier, "to_id", "left_anti")
    asks = open_.select("from_id", F.col("to_id").alias("ask_id"), P.purl_type("to_id").alias("ecosystem"), P.purl_name("to_id").alias("name"), "spec", "scope", "kind")
    rest = edges.where(~bare).unionByName(edges.where(bare).join(frontier, "to_id", "left_semi"))
    named = nodes.select("id")
    implied = rest.select(F.col("to_id").alias("id")).distinct().join(named, "id", "left_anti").select(
        "id", P.purl_type("id").alias("ecosystem"), P.purl_name("id").alias("name"), P.purl_version("id").alias("version"),
        F.when(P.purl_version("id") == "", "declared").otherwise("resolved").alias("completeness"), F.lit(0).alias("ord"),
    )
    return _nodes(nodes).unionByName(_nodes(implied)), _edges(rest), asks


def walk(nodes: DataFrame, edges: DataFrame, root: str, versions: DataFrame, requirements: DataFrame, bounds: Bounds = Bounds(), pins: DataFrame | None = None) -> Closure:
    """Expand a repository's requirements to their closure.

    ``versions``: ``ecosystem, name, version, published_at``; ``requirements``:
    ``ecosystem, name, version, dep_name, spec, scope``. Ecosystems without any
    registry rows are taken as offline: requirements stay declared. Dev
    dependencies of dependencies are not installed and end with that reason.
    """
    began = time.monotonic()
    known, concrete, asks = seed(nodes, edges)
    start = nodes.sparkSession.createDataFrame([(root, "generic", "resolved", 0)], "id string, ecosystem string, completeness string, ord long")
    known = cut(_nodes(start).unionByName(known))
    concrete = cut(concrete)
    registry = cut(E.as_of(versions, bounds.as_of))
    online = cut(registry.select("ecosystem").distinct().withColumn("__online", F.lit(True)))
    hit: list[str] = []
    total, depth = known.count(), 0
    asks = cut(asks)
    while not asks.isEmpty():
        stop = None
        if depth >= bounds.max_depth:
            stop = "bound:depth"
        elif bounds.max_nodes is not None and total >= bounds.max_nodes:
            stop = "bound:nodes"
        elif bounds.seconds is not None and time.monotonic() - began > bounds.seconds:
            stop = "bound:timeout"
        if stop:
            hit += [stop] if stop not in hit else []
            new_nodes, new_edges = _left(asks, stop)
            known, concrete = cut(known.unionByName(new_nodes)), cut(concrete.unionByName(new_edges))
            break
        fresh = cut(asks.select("ecosystem", "name", "spec").distinct())
        # of the registry only what this level asks for
        near = cut(registry.join(_asked(fresh.select("ecosystem", "name").distinct()), ["ecosystem", "name"], "left_semi"))
        listed = near.select("ecosystem", "name").distinct().withColumn("__listed", F.lit(True))
        undated = near.where("undated").select("ecosystem", "name").distinct().withColumn("__undated", F.lit(True))
        usable = near.where("NOT undated").drop("undated")
        picked = E.enumerate_versions(fresh, usable, bounds.mode, bounds.versions_per_range)
        if bounds.mode == "will" and pins is not None:
            picked = E.apply_pins(fresh, picked, pins, usable)
        else:
            picked = picked.withColumn("reason", F.lit(None).cast("string"))
        picked = cut(picked.join(by_key(usable.select("ecosystem", "name", "version", "published_at")), ["ecosystem", "name", "version"], "left"))
        # nothing picked: say why
        state = asks.join(by_key(listed), ["ecosystem", "name"], "left").join(online, "ecosystem", "left").join(by_key(undated), ["ecosystem", "name"], "left")
        lost = state.join(by_key(picked.select("ecosystem", "name", "spec").distinct()), ["ecosystem", "name", "spec"], "left_anti")
        why = (
            F.when(F.col("__online").isNull(), "offline")
            .when(F.col("__undated"), "error:undated")
            .when(F.col("__listed").isNull(), "error:404")
            .otherwise("error:badrange")
        )
        lost_nodes, lost_edges = _left(lost.withColumn("why", why), None)
        got = asks.join(by_key(picked), ["ecosystem", "name", "spec"])
        target = P.purl("ecosystem", "name", "version")
        got = cut(got.withColumn("id", target))
        met = got.select("id").distinct().join(by_key(known.select("id").distinct()), "id", "left_anti")
        room = None if bounds.max_nodes is None else bounds.max_nodes - total
        over = None
        if room is not None and met.limit(room + 1).count() > room:
            # the level reaches the bound: the smallest ids that still fit are expanded
            hit.append("bound:nodes")
            over = cut(met.join(met.orderBy("id").limit(room), "id", "left_anti").withColumn("__over", F.lit("bound:nodes")))
            got = cut(got.join(over, "id", "left").withColumn("reason", F.coalesce("__over", "reason")).drop("__over"))
        new_nodes = got.select("id", "ecosystem", "name", "version", F.when(F.col("reason").isNull(), "resolved").otherwise("declared").alias("completeness"), "reason", "published_at", F.lit(depth + 1).cast("long").alias("ord")).dropDuplicates(["id"])
        new_edges = got.select("from_id", F.col("id").alias("to_id"), "kind", "spec", "scope", F.lit("declared").alias("origin"))
        # children of versions met for the first time
        first = new_nodes.join(by_key(known.where("ord > 0").select("id")), "id", "left_anti")
        if over is not None:
            first = first.join(over, "id", "left_anti")
        first = cut(first.select("id", "ecosystem", "name", "version"))
        kids = requirements.join(_asked(first), ["ecosystem", "name", "version"])
        kids = kids.select(F.col("id").alias("from_id"), "ecosystem", F.col("dep_name").alias("name"), "spec", "scope", F.lit("depends_on").alias("kind"))
        kids = cut(kids.withColumn("ask_id", P.purl("ecosystem", "name")))
        skipped_nodes, skipped_edges = _left(kids.where("scope = 'dev'"), "dev-not-installed")
        # only what is new is written; a walk has few levels
        known = known.unionByName(cut(_nodes(new_nodes).unionByName(lost_nodes).unionByName(skipped_nodes).dropDuplicates(["id", "completeness", "reason"])))
        concrete = concrete.unionByName(cut(_edges(new_edges).unionByName(lost_edges).unionByName(skipped_edges).distinct()))
        asks = kids.where("scope <> 'dev'").distinct()
        depth += 1
        total = known.select("id").distinct().count() if bounds.max_nodes is not None else total
    return Closure(cut(upsert_nodes(known)), cut(concrete.distinct()), depth, hit)


def _asked(rows: DataFrame) -> DataFrame:
    """One side of a join with a registry table: sent to its rows if it is short."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else by_key(rows)


def _left(asks: DataFrame, reason: str | None) -> tuple[DataFrame, DataFrame]:
    """Requirements that are not followed, as frontier nodes with a reason."""
    why = F.lit(reason) if reason is not None else F.col("why")
    rows = asks.withColumn("__why", why)
    nodes = rows.groupBy(F.col("ask_id").alias("id"), "ecosystem", "name").agg(F.min("__why").alias("reason")).select("id", "ecosystem", "name", F.lit("").alias("version"), F.lit("declared").alias("completeness"), "reason", F.lit(1 << 40).alias("ord"))
    edges = rows.select("from_id", F.col("ask_id").alias("to_id"), "kind", "spec", "scope", F.lit("declared").alias("origin"))
    return _nodes(nodes), _edges(edges)
