"""What the training-data operators share: table access, materialised
intermediates in the cluster's shared folder, and connected components.

Nothing here reads a file except through Spark, so any store Spark can open
works as input, and every intermediate lands in the folder that
``spark.checkpoint.dir`` names, which all executors see.
"""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_created: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; where none is set, one in the warehouse, or in
    local mode (tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    # executors of a cluster share the warehouse, not the driver's temporary folder
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/plumbline-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the whole
    plan. The folder goes when the application ends, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    if not _created:
        atexit.register(_sweep)
    _created.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has columns of these names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def release(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _created:
            _created.remove(path)


def forget_shuffles(df: DataFrame) -> None:
    """Let the executors delete the shuffle files of steps that have ended. They do
    so when the driver's garbage is collected, which may otherwise take hours."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_created):
        try:
            _delete(spark, path)
        except Exception:  # the gateway may already be gone at exit
            return


#: A written table is only broadcast if its files have at most this many bytes.
BROADCAST_BYTES = 8 << 20


def checked(df: DataFrame) -> DataFrame:
    """``df``, from materialise(), to be broadcast if its files are small, else
    left to the planner, which shuffles what it does not know to be small."""
    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES else df


def written_bytes(df: DataFrame) -> int:
    """The size of the files of a table from materialise()."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def hash_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """The ``rows`` rows of ``df`` with the smallest hashes of ``cols``, in that
    order; all if there are fewer. Counts first, so that only about twice as many
    rows meet in the task that sorts them, whatever the number of partitions."""
    hashed = F.xxhash64(*cols)
    total = df.count()
    if total > 2 * rows:  # the chance of fewer than ``rows`` below the edge is nil for rows beyond some tens
        edge = -(1 << 63) + int((1 << 64) * (1.5 * rows + 200) / total)
        df = df.where(hashed < min(edge, (1 << 63) - 1))
    return df.orderBy(hashed, *cols).limit(rows)


def row_key(*cols: str) -> Column:
    """One long that stands for a row's content, null-safe."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an edge list.

    ``edges``: columns ``a`` and ``b`` of one orderable type. Returns
    ``node``, ``component`` for each node that has an edge; ``component`` is
    the smallest node of its connected group (itself included).

    Alternating star contraction: *large star* hangs a node's larger
    neighbours on its smallest neighbour, *small star* does so for the smaller
    ones. Both only shuffle edges, never gather a group, and the edge count
    never grows; the rounds are logarithmic in the longest chain. Each round
    is written to the shared folder, so lineage stays flat.
    """
    current = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    mark = _mark(current)
    for round_ in itertools.count():
        if mark[0] == 0:
            break
        if round_ == max_rounds:
            raise RuntimeError(f"components not found in {max_rounds} rounds")
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialise(large)
        # every edge now points from the larger node to the smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        after = materialise(small)
        release(current)
        release(large)
        current, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = current.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
