"""Graph operators on ``edges(from_id, to_id, ...)``: distributed fixpoints.

Every loop is bounded by a named parameter, joins only the frontier, and cuts
its lineage once a round. Nodes are never gathered; the driver sees counts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.purl import is_package
from plumbline.functions.scalars import upgrade_rank
from plumbline.operators.workspace import cut

PATH_CAP = 10_000
#: Levels whose counts are unioned before they are written together.
LEVELS = 16


def rounds(most: int) -> Iterator[int]:
    """The rounds of a fixpoint; one that needs more is an error, not a result."""
    yield from range(most)
    raise RuntimeError(f"no fixpoint in {most} rounds")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Multiplicity lives on edges: one row for each of the five fields."""
    return edges.dropDuplicates(["from_id", "to_id", "kind", "spec", "scope"])


def upsert_nodes(nodes: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One row for each id: the most complete, the earliest among equals."""
    rest = [c for c in nodes.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct(upgrade_rank(F.col("completeness")), -F.col(ordinal)))
    return nodes.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def inbound(edges: DataFrame, node: str) -> DataFrame:
    """Why is this here? Edges into a node in total order."""
    return edges.where(F.col("to_id") == node).orderBy("from_id", "kind", "spec", "scope")


def package_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_package("from_id") & is_package("to_id")).select("from_id", "to_id").distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """``id, depth, reason``: breadth-first closure of ``seeds(id)``.

    ``reason`` is null for expanded nodes; nodes reached but not expanded carry
    the bound that stopped them, ``bound:depth`` or ``bound:nodes``. A node that
    has no edges to follow is complete, whatever the bound.
    """
    pairs = edges.select("from_id", "to_id").distinct()
    visited = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, total = visited, visited.count()
    stopped = "bound:depth"
    for depth in range(1, max_depth + 1):
        step = frontier.join(pairs, frontier["id"] == pairs["from_id"]).select(F.col("to_id").alias("id")).distinct()
        step = cut(step.join(visited, "id", "left_anti").withColumn("depth", F.lit(depth)))
        n = step.count()
        if n == 0:
            frontier = step
            break
        visited, frontier, total = cut(visited.unionByName(step)), step, total + n
        if max_nodes is not None and total >= max_nodes:
            stopped = "bound:nodes"
            break
    last = frontier.select("id").join(pairs.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi").withColumn("reason", F.lit(stopped))
    return visited.join(last, "id", "left")


def reachable(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, blocked: DataFrame | None = None) -> DataFrame:
    """``source, id`` for every node a source reaches, itself included.

    ``sources``: ``source, id`` to start from. Nodes in ``blocked(id)`` are not
    entered.
    """
    pairs = edges.select("from_id", "to_id").distinct()
    if blocked is not None:
        pairs = pairs.join(blocked.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_anti").select("from_id", "to_id")
    pairs = cut(pairs)
    seen = cut(sources.select("source", "id").distinct())
    frontier = seen
    for _ in rounds(max_rounds):
        step = frontier.join(pairs, frontier["id"] == pairs["from_id"]).select("source", F.col("to_id").alias("id")).distinct()
        frontier = cut(step.join(seen, ["source", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def paths_to(edges: DataFrame, root: str, target: str, k: int, max_length: int = 32) -> DataFrame:
    """``path`` (array of ids), ``length``: the k shortest simple chains from
    ``root`` to ``target``, ties in id order. Chains grow backwards from the target
    and only through nodes the root reaches."""
    spark = edges.sparkSession
    live = reachable(edges, spark.createDataFrame([(root, root)], "source string, id string")).select(F.col("id").alias("from_id"))
    pairs = cut(edges.select("from_id", "to_id").distinct().join(live, "from_id", "left_semi"))
    chains = spark.createDataFrame([([target],)], "path array<string>")
    found = chains.where(F.lit(root == target))
    for _ in range(max_length):
        grown = chains.join(pairs, F.element_at("path", 1) == F.col("to_id")).where(~F.array_contains("path", F.col("from_id")))
        chains = cut(grown.select(F.concat(F.array("from_id"), "path").alias("path")))
        if chains.isEmpty():
            break
        done = F.element_at("path", 1) == root
        found = cut(found.unionByName(chains.where(done)))
        if found.count() >= k:
            break
        chains = chains.where(~done)
    return found.withColumn("length", F.size("path") - 1).orderBy("length", "path").limit(k)


def scc(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``id, component``: strongly connected components, named by their smallest ids.

    Chains go first: a node with one edge in and one out is in the component of its
    chain's two ends if they share one, else alone; so a chain becomes one edge, in
    rounds logarithmic in its length. Then each round, by forward colouring, every
    live node takes the smallest id that reaches it; inside a colour, what reaches
    the colour's own node is its component, and leaves.
    """
    live = cut(nodes.select("id").distinct())
    pairs = edges.select("from_id", "to_id").distinct().where("from_id <> to_id")
    pairs = cut(pairs.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi"))
    done, chained = None, []
    for _ in rounds(max_rounds):
        size = live.count()
        alone, ringed, inner, live, pairs = _chains(live, pairs, max_rounds)
        done = alone.unionByName(ringed) if done is None else done.unionByName(alone).unionByName(ringed)
        chained.append(inner)
        if live.isEmpty() or live.count() * 2 > size:
            break
    for _ in rounds(max_rounds):
        if live.isEmpty():
            break
        colour = _least_reaching(live, pairs, max_rounds)
        inside = (
            pairs.join(colour.select(F.col("id").alias("from_id"), F.col("c").alias("cf")), "from_id")
            .join(colour.select(F.col("id").alias("to_id"), F.col("c").alias("ct")), "to_id")
            .where("cf = ct")
            .select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        )
        # a colour's own node is its smallest: what reaches it reaches no smaller one inside
        back = _least_reaching(live, cut(inside), max_rounds).withColumnRenamed("c", "component")
        members = cut(back.join(colour, "id").where("component = c").select("id", "component"))
        done = done.unionByName(members)
        live = cut(live.join(members, "id", "left_anti"))
        pairs = cut(pairs.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi"))
    # chains go back in, the last taken out first; their members may be smaller than their ends
    for inner in reversed(chained):
        done = cut(done)
        start, end = (done.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("start", "end"))
        put = inner.join(start, "start").join(end, "end")
        done = done.unionByName(put.select("id", F.when(F.col("cstart") == F.col("cend"), F.col("cstart")).otherwise(F.col("id")).alias("component")))
    done = cut(done)
    least = done.groupBy("component").agg(F.min("id").alias("least"))
    return done.join(least, "component").select("id", F.col("least").alias("component"))


def _chains(live: DataFrame, pairs: DataFrame, max_rounds: int) -> tuple[DataFrame, ...]:
    """Takes out nodes with one edge in and one out, and nodes without either.

    Returns ``id, component`` of the nodes that are alone and of rings of such nodes;
    ``id, start, end`` of the nodes between two others; and the nodes and edges left.
    """
    out = pairs.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("outs"), F.min("to_id").alias("after"))
    into = pairs.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("ins"), F.min("from_id").alias("before"))
    degrees = cut(live.join(out, "id", "left").join(into, "id", "left"))
    alone = degrees.where("outs IS NULL OR ins IS NULL")
    links = cut(degrees.where("outs = 1 AND ins = 1").select("id", F.col("after").alias("end"), F.col("before").alias("start"), F.col("id").alias("least")))
    total, seen = links.count(), 1
    # each round doubles the way a node has looked along its chain, both ways
    for _ in rounds(max_rounds):
        onward = links.select(F.col("id").alias("end"), F.col("end").alias("__end"), F.col("least").alias("__least"))
        back = links.select(F.col("id").alias("start"), F.col("start").alias("__start"))
        step = links.join(onward, "end", "left").join(back, "start", "left")
        links = cut(step.select("id", F.coalesce("__end", "end").alias("end"), F.coalesce("__start", "start").alias("start"), F.least("least", F.coalesce("__least", "least")).alias("least")))
        seen *= 2
        if seen > total or links.join(links.select(F.col("id").alias("end")), "end", "left_semi").isEmpty():
            break
    # what has not met an end in as many steps as there are nodes is on a ring
    ring = links.join(links.select(F.col("id").alias("end")), "end", "left_semi").select("id", F.col("least").alias("component"))
    ring = cut(ring)
    inner = cut(links.join(ring, "id", "left_anti").select("id", "start", "end"))
    gone = links.select("id").unionByName(alone.select("id"))
    live = cut(live.join(gone, "id", "left_anti"))
    # an end that is alone now leaves with its edges; both ends of a chain keep its place
    ends = pairs.unionByName(inner.select(F.col("start").alias("from_id"), F.col("end").alias("to_id"))).where("from_id <> to_id").distinct()
    pairs = cut(ends.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi"))
    return alone.select("id", F.col("id").alias("component")), ring, inner, live, pairs


def _least_reaching(live: DataFrame, pairs: DataFrame, max_rounds: int) -> DataFrame:
    """``id, c``: the smallest id that reaches each node, itself included. What reaches
    the smallest found so far reaches the node too, so finds are passed on in leaps."""
    colour = cut(live.withColumn("c", F.col("id")))
    for _ in rounds(max_rounds):
        pushed = pairs.join(colour, pairs["from_id"] == colour["id"]).groupBy(F.col("to_id").alias("id")).agg(F.min("c").alias("p"))
        leapt = colour.select(F.col("id").alias("c"), F.col("c").alias("l"))
        after = colour.join(pushed, "id", "left").join(leapt, "c", "left")
        after = cut(after.select("id", F.least("c", F.coalesce("p", "c"), F.coalesce("l", "c")).alias("least"), "c"))
        moved = after.where("least < c").limit(1).count()
        colour = after.select("id", F.col("least").alias("c"))
        if not moved:
            break
    return colour


def path_counts(nodes: DataFrame, edges: DataFrame, root: str, cap: int = PATH_CAP, components: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``id, paths``: distinct routes from the root through the condensation.

    Parallel edges between two components count once, members of a component
    share its count, counts saturate at ``cap``, and nodes not downstream of the
    root have none. One round per level: a component is counted when all its
    predecessors downstream of the root are.
    """
    comp = cut(components if components is not None else scc(nodes, edges))
    ends = edges.select("from_id", "to_id").distinct()
    ends = (
        ends.join(comp.select(F.col("id").alias("from_id"), F.col("component").alias("f")), "from_id")
        .join(comp.select(F.col("id").alias("to_id"), F.col("component").alias("t")), "to_id")
        .where("f <> t")
        .select(F.col("f").alias("from_id"), F.col("t").alias("to_id"))
        .distinct()
    )
    start = comp.where(F.col("id") == root).select("component")
    down = reachable(ends, start.select(F.col("component").alias("source"), F.col("component").alias("id"))).select("id")
    ends = cut(ends.join(down.select(F.col("id").alias("from_id")), "from_id", "left_semi"))
    needs = cut(ends.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("need")))
    counted = cut(start.select(F.col("component").alias("id"), F.lit(1).cast("long").alias("paths")))
    found, partial, frontier = [counted], None, counted
    for _ in rounds(max_rounds):
        step = frontier.join(ends, frontier["id"] == ends["from_id"]).groupBy(F.col("to_id").alias("id")).agg(F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("got"))
        partial = step if partial is None else partial.unionByName(step).groupBy("id").agg(F.sum("paths").alias("paths"), F.sum("got").alias("got"))
        state = cut(partial.select("id", F.least("paths", F.lit(cap)).alias("paths"), "got").join(needs, "id"))
        frontier = state.where("got = need").select("id", "paths")
        if frontier.isEmpty():
            break
        partial = state.where("got < need").select("id", "paths", "got")
        found.append(frontier)
        if len(found) == LEVELS:
            found = [cut(functools.reduce(DataFrame.unionByName, found))]
    counted = functools.reduce(DataFrame.unionByName, found)
    return comp.join(counted.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("paths", F.lit(0)).cast("int").alias("paths"))


def run_metrics(edges: DataFrame, cap: int = PATH_CAP) -> DataFrame:
    """``run_id, id, component, paths`` with one bounded task per run.

    For many runs of at most ``max_nodes`` nodes each (the closure bound), where a
    task per run beats rounds over all runs. ``edges``: ``run_id, from_id, to_id,
    root``. Agrees with scc() and path_counts().
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        ids = sorted(set(pdf.from_id) | set(pdf.to_id))
        for a, b in sorted(set(zip(pdf.from_id, pdf.to_id))):
            out.setdefault(a, []).append(b)
        comp = _components(ids, out)
        nexts: dict[str, set[str]] = {}
        for a, bs in out.items():
            nexts.setdefault(comp[a], set()).update(comp[b] for b in bs if comp[b] != comp[a])
        paths = _routes(comp.get(pdf.root.iloc[0]), nexts, cap)
        return pd.DataFrame({"run_id": pdf.run_id.iloc[0], "id": ids, "component": [comp[i] for i in ids], "paths": [paths.get(comp[i], 0) for i in ids]})

    return edges.groupBy("run_id").applyInPandas(one, "run_id string, id string, component string, paths int")


def _components(ids: list[str], out: dict[str, list[str]]) -> dict[str, str]:
    """Two depth-first passes: finishing order, then reversed edges."""
    order, seen = [], set()
    for start in ids:
        stack: list[tuple[str, Iterator[str]]] = [] if start in seen else [(start, iter(out.get(start, ())))]
        seen.add(start)
        while stack:
            node, kids = stack[-1]
            kid = next((k for k in kids if k not in seen), None)
            if kid is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(kid)
                stack.append((kid, iter(out.get(kid, ()))))
    into: dict[str, list[str]] = {}
    for a, bs in out.items():
        for b in bs:
            into.setdefault(b, []).append(a)
    comp: dict[str, str] = {}
    for root in reversed(order):
        if root in comp:
            continue
        members, stack2 = [], [root]
        comp[root] = root
        while stack2:
            node = stack2.pop()
            members.append(node)
            for p in into.get(node, ()):
                if p not in comp:
                    comp[p] = root
                    stack2.append(p)
        name = min(members)
        for m in members:
            comp[m] = name
    return comp


def _routes(root: str | None, nexts: dict[str, set[str]], cap: int) -> dict[str, int]:
    if root is None:
        return {}
    down, stack = {root}, [root]
    while stack:
        for t in nexts.get(stack.pop(), ()):
            if t not in down:
                down.add(t)
                stack.append(t)
    need = dict.fromkeys(down, 0)
    for f in down:
        for t in nexts.get(f, ()):
            need[t] += 1
    paths, ready = dict.fromkeys(down, 0), [root]
    paths[root] = 1
    while ready:
        f = ready.pop()
        for t in nexts.get(f, ()):
            paths[t] = min(cap, paths[t] + paths[f])
            need[t] -= 1
            if not need[t]:
                ready.append(t)
    return paths


def attribution(direct: DataFrame, affected: DataFrame, edges: DataFrame) -> DataFrame:
    """``direct, id``: affected nodes each direct dependency brings in, reached
    without entering another direct dependency; itself counts if affected."""
    starts = direct.select(F.col("id").alias("source"), "id")
    return reachable(edges, starts, blocked=direct).join(affected.select("id").distinct(), "id", "left_semi").select(F.col("source").alias("direct"), "id")


def introducers(pairs: DataFrame) -> DataFrame:
    """``direct, affected, exclusive`` from attribution() pairs."""
    owners = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("owners"))
    return pairs.join(owners, "id").groupBy("direct").agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("owners") == 1).alias("exclusive"))


def greedy_plan(pairs: DataFrame, limit: int = 5) -> DataFrame:
    """``step, direct, affected, gain``: direct dependencies picked by how many
    affected nodes they newly clear; ties go to the smallest name."""
    spark = pairs.sparkSession
    left, picked = cut(pairs.distinct()), []
    sizes = pairs.groupBy("direct").agg(F.count(F.lit(1)).alias("affected"))
    for step in range(1, limit + 1):
        best = left.groupBy("direct").agg(F.count(F.lit(1)).alias("gain")).orderBy(F.desc("gain"), "direct").first()
        if best is None:
            break
        picked.append((step, best["direct"], best["gain"]))
        cleared = left.where(F.col("direct") == best["direct"]).select("id")
        left = cut(left.join(cleared, "id", "left_anti"))
    plan = spark.createDataFrame(picked, "step int, direct string, gain long")
    return plan.join(sizes, "direct").select("step", "direct", "affected", "gain")


def induced_subgraph(edges: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """Edges inside ``members(id)``; a member without any hangs on the root
    with the kind of its first inbound edge outside."""
    inside = edges.join(members.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(members.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    orphans = members.select("id").where(F.col("id") != root).join(inside.select(F.col("to_id").alias("id")), "id", "left_anti")
    first = edges.groupBy(F.col("to_id").alias("id")).agg(F.min_by("kind", F.struct("from_id", "kind")).alias("kind"))
    hung = orphans.join(first, "id", "left").select(F.lit(root).alias("from_id"), F.col("id").alias("to_id"), F.coalesce("kind", F.lit("depends_on")).alias("kind"))
    return inside.select("from_id", "to_id", "kind").unionByName(hung)


def split_units(nodes: DataFrame, edges: DataFrame, instances: DataFrame, remainder: str = "_repo") -> DataFrame:
    """``unit, id``: nodes by the deliverable that ships them - a lockfile's
    folder, else the build files that reach them, else the remainder."""
    folder = F.regexp_extract("locator", r"^([^#]*)#", 1)
    placed = instances.select(F.when(folder == "", ".").otherwise(folder).alias("unit"), F.col("node_id").alias("id")).distinct()
    files = nodes.where(F.col("id").startswith("pkg:generic/buildfile/"))
    built = reachable(edges, files.select(F.regexp_extract("id", r"#(.*)$", 1).alias("source"), "id")).select(F.col("source").alias("unit"), "id")
    built = built.join(placed.select("id").distinct(), "id", "left_anti").select("unit", "id")
    known = placed.unionByName(built)
    rest = nodes.select("id").join(known.select("id").distinct(), "id", "left_anti").select(F.lit(remainder).alias("unit"), "id")
    return known.unionByName(rest)


def worst(column: str, rank: Column) -> Column:
    return F.max_by(column, rank)
