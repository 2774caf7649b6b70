"""Approximate nearest neighbours with a hierarchical k-means tree (operator 4).

A tree of k-means splits is fitted on the driver over a bounded sample
(``SAMPLE_ROWS`` vectors with the smallest hashes of their ids); every row of
the table is then indexed under the leaf it descends to. A query walks the
tree best bin first: a priority queue of nodes by inner product with their
centres, leaves visited in the order they are popped.

How many leaves are visited is calibrated, not guessed: for up to
``CALIBRATION`` queries the exact neighbours over all rows are found by one
scan, and visits widen until their mean recall reaches ``RECALL``.

The search is a join on groups of leaves of about ``CELL`` rows. A larger leaf,
and queries beyond a bound, are cut into slices whose pairs are cells of their
own, so a leaf that holds a third of all rows is spread over tasks. In a
cell all but the ``k + 1`` smallest ids of equal vectors are set aside before
comparing, which cannot change any result: they tie exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import hash_sample, materialise

SAMPLE_ROWS = 20_000
CALIBRATION = 128
RECALL = 0.97
CELL = 4_096
#: Queries compared at a time.
BLOCK = 512
BRANCHES = 8
LEAF_ROWS = 100


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm with spread-out starts; empty clusters are dropped."""
    centres = x[rng.integers(len(x))][None, :]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.max() > 0:
        pick = x[rng.choice(len(x), p=near / near.sum())]
        centres = np.vstack((centres, pick))
        near = np.minimum(near, ((x - pick) ** 2).sum(axis=1))
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        used = np.unique(own)
        centres = np.stack([x[own == c].mean(axis=0) for c in used])
    own = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
    return centres, own


@dataclass
class Tree:
    """Nodes in one array; ``children[i]`` is None for a leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int] | None] = field(default_factory=list)

    def grow(self, x: np.ndarray, rng: np.random.Generator, branches: int, leaf_rows: int) -> int:
        at = len(self.centres)
        self.centres.append(x.mean(axis=0))
        self.children.append(None)
        if len(x) > leaf_rows:
            _, own = kmeans(x, branches, rng)
            groups = [x[own == c] for c in np.unique(own)]
            if len(groups) > 1:
                self.children[at] = [self.grow(g, rng, branches, leaf_rows) for g in groups]
        return at

    def pack(self) -> Tree:
        self.matrix = np.stack(self.centres)
        self.squares = (self.matrix**2).sum(axis=1)
        return self

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if c is None]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to: nearest centre at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if kids is None:
                out[rows] = node
                continue
            pick = np.argmin(self.squares[kids][None, :] - 2 * x[rows] @ self.matrix[kids].T, axis=1)
            todo.extend((kids[c], rows[pick == c]) for c in np.unique(pick))
        return out

    def visit(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """``most`` leaves in best-bin-first order, and more while they have fewer
        than ``least`` rows by ``sizes``."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids is None:
                out.append(node)
                seen += sizes.get(node, 0) if sizes else 0
                continue
            for score, kid in zip((-(self.matrix[kids] @ q)).tolist(), kids):
                heapq.heappush(queue, (score, kid))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def top(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, allowed: np.ndarray | None = None, v_part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` largest inner products, ties to smaller ids, own id
    left out: query row numbers, ids, scores. ``allowed[i, p]`` says whether
    query ``i`` may see rows of part ``p``. Scores are summed the same way for
    every pair, so equal vectors tie exactly; memory is bounded by a block."""
    order = np.argsort(v_ids, kind="stable")
    v, v_ids = v[order], v_ids[order]
    _, group = np.unique(v, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    kept = np.sort(by[rank <= k])
    v, v_ids = v[kept], v_ids[kept]
    part = v_part[order][kept] if v_part is not None else None
    rows, ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for at in range(0, len(q), BLOCK):
        rough = q[at : at + BLOCK] @ v.T
        if allowed is not None:
            rough[~allowed[at : at + BLOCK][:, part]] = -np.inf
        for i, r in enumerate(rough, at):
            edge = np.partition(r, len(r) - k - 1)[len(r) - k - 1] if len(r) > k + 1 else -np.inf
            near = np.flatnonzero((r >= edge - 1e-9 * max(1.0, abs(edge))) & (r > -np.inf)) if edge > -np.inf else np.flatnonzero(r > -np.inf)
            near = near[v_ids[near] != q_ids[i]]
            exact = (v[near] * q[i]).sum(axis=1)
            best = np.lexsort((v_ids[near], -exact))[:k]
            rows.append(np.full(len(best), i))
            ids.append(v_ids[near][best])
            scores.append(exact[best])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows that can take part - an id, a vector of the table's
    most common length, finite and not all zero; identical repeated rows once."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok).distinct()
    rows = materialise(rows)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 20,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each
    query, itself excluded, by largest inner product in double precision.

    ``table`` and ``queries``: ``vec_id, v`` from clean_vectors(); all vectors
    have one length. Ties go to the smaller id. An empty table or query set
    gives no rows. Ids repeated with other vectors are candidates each.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sampled = hash_sample(table, sample_rows, "vec_id", "v").toArrow()
    if not sampled.num_rows:
        return spark.createDataFrame([], schema)
    dim = len(sampled.column("v")[0])
    tree = Tree()
    tree.grow(_matrix(sampled.column("v"), dim), np.random.default_rng(11), BRANCHES, LEAF_ROWS)
    held = spark.sparkContext.broadcast(tree.pack())  # at most sample_rows centres, bounded

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = held.value.leaf_of(_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "leaf"])

    indexed = materialise(table.select("vec_id", "v").mapInArrow(index, "vec_id long, v array<double>, leaf int"))
    # one row for each leaf, so bounded like the tree
    sizes = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("nv")).collect()
    per_leaf = {r["leaf"]: r["nv"] for r in sizes}
    visits = _calibrate(indexed, queries, tree, dim, k, recall, calibration)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = [held.value.visit(q, visits, per_leaf, k + 1) for q in _matrix(b.column(1), dim)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "leaves"])

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(walk, "query_id long, q array<double>, leaves array<int>")
    asked = materialise(asked.select("query_id", "q", F.explode("leaves").alias("leaf")))
    wants = {r["leaf"]: r["nq"] for r in asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("nq")).collect()}
    dealt = _groups([{"leaf": leaf, "nv": nv, "nq": wants[leaf]} for leaf, nv in sorted(per_leaf.items()) if leaf in wants])
    plan = lambda: F.broadcast(spark.createDataFrame(dealt, "leaf int, grp int, sv int, sq int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = asked.join(plan(), "leaf").select(
        "grp", F.explode(upto("sv")).alias("cv"), F.pmod(F.xxhash64("query_id"), F.col("sq")).cast("int").alias("cq"), "leaf", "query_id", "q"
    )
    right = indexed.join(plan(), "leaf").select(
        "grp", F.pmod(F.xxhash64("vec_id"), F.col("sv")).cast("int").alias("cv"), F.explode(upto("sq")).alias("cq"), "leaf", "vec_id", "v"
    )

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        leaves, v_part = np.unique(v.column("leaf").to_numpy(), return_inverse=True)
        # one row for each query, and which of the cell's leaves it visits
        asks = np.column_stack((q.column("query_id").to_numpy()[:, None].view(np.uint64), _matrix(q.column("q"), dim).view(np.uint64)))
        asks, row = np.unique(asks, axis=0, return_inverse=True)
        q_ids, qm = asks[:, 0].copy().view(np.int64), np.ascontiguousarray(asks[:, 1:]).view(np.float64)
        allowed = np.zeros((len(asks), len(leaves)), bool)
        q_leaf = q.column("leaf").to_numpy()
        here = np.isin(q_leaf, leaves)
        allowed[row.ravel()[here], np.searchsorted(leaves, q_leaf[here])] = True
        rows, ids, scores = top(qm, q_ids, _matrix(v.column("v"), dim), v.column("vec_id").to_numpy(), k, allowed, v_part)
        return pa.table({"query_id": q_ids[rows], "vec_id": ids, "score": scores})

    keys = ("grp", "cv", "cq")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _groups(leaves: list) -> list[tuple[int, int, int, int]]:
    """``leaf, grp, sv, sq``: small leaves share a group of about ``CELL`` rows,
    so that a query emits its best once for all of them; a large leaf is alone in
    its group, in ``sv`` slices. ``sq`` slices keep a cell's queries bounded."""
    out, grp, members, rows, asked = [], 0, [], 0, 0

    def close():
        nonlocal grp, members, rows, asked
        if members:
            sv, sq = max(1, -(-rows // CELL)) if len(members) == 1 else 1, max(1, -(-asked // (16 * CELL)))
            out.extend((leaf, grp, sv, sq) for leaf in members)
            grp, members, rows, asked = grp + 1, [], 0, 0

    for r in leaves:
        if members and rows + r["nv"] > CELL:
            close()
        members.append(r["leaf"])
        rows, asked = rows + r["nv"], asked + r["nq"]
    close()
    return out


def exact_nearest(indexed: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Exact neighbours of a bounded set of query vectors by one scan."""
    dim = vectors.shape[1]
    held = indexed.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        for b in batches:
            for at in range(0, b.num_rows, CELL):
                part = b.slice(at, CELL)
                v_ids = part.column(0).to_numpy()
                rows, found, scores = top(q, q_ids, _matrix(part.column(1), dim), v_ids, k)
                leaf = part.column(2).to_numpy()
                by = np.argsort(v_ids)
                at_leaf = leaf[by[np.searchsorted(v_ids[by], found)]]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(found), pa.array(scores), pa.array(at_leaf.astype(np.int32))], names=["query_id", "vec_id", "score", "leaf"])

    rows = indexed.select("vec_id", "v", "leaf").mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float, calibration: int) -> int:
    """Leaves to visit so that the mean recall of sampled queries is reached."""
    chosen = hash_sample(queries.select("vec_id", "v", F.lit("c").alias("salt")), calibration, "vec_id", "v", "salt").select("vec_id", "v").toArrow()
    if not chosen.num_rows:
        return 1
    ids, vectors = chosen.column("vec_id").to_numpy(), _matrix(chosen.column("v"), dim)
    truth: dict[int, list[int]] = {}
    for r in exact_nearest(indexed, ids, vectors, k).select("query_id", "leaf").collect():  # calibration * k rows
        truth.setdefault(r["query_id"], []).append(r["leaf"])
    every = len(tree.leaves)
    shares = np.zeros(every)
    for i, q in zip(ids.tolist(), vectors):
        place = {leaf: n for n, leaf in enumerate(tree.visit(q, every))}
        for leaf in truth.get(i, []):
            shares[place[leaf]] += 1 / len(truth[i]) / len(ids)
    reached = np.flatnonzero(np.cumsum(shares) >= min(recall, shares.sum()) - 1e-12)
    return int(reached[0]) + 1 if len(reached) else every
