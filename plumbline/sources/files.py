"""Files of repositories as rows, reading only what something claims."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.extractors import CLAIMS
from plumbline.sources.lockfiles import READERS
from plumbline.sources.toolbox import lookup

#: Folders of dependencies, builds and caches, never scanned.
SKIPPED_FOLDERS = (
    ".git", "node_modules", "vendor", "target", "dist", "build", "out", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", ".next", ".nuxt",
    ".terraform", "bower_components", ".cache", "site-packages", "third_party",
)


def wanted(path: str) -> bool:
    """Whether an extractor, a lockfile reader or the tool catalogue claims a path."""
    patterns = [*CLAIMS.values(), *[p for p, _ in READERS.values()]]
    return any(re.search(p, path) for p in patterns) or lookup(path) is not None


def _listing(spark: SparkSession, root: str, largest: int | None) -> tuple[object, list[tuple[str, str]]]:
    """Claimed files below a folder as (path, path inside it). Spark's own listing
    passes over hidden names, which most build files have."""
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = start.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [(start, "")]
    while todo:
        folder, inside = todo.pop()
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory():
                if name not in SKIPPED_FOLDERS:
                    todo.append((status.getPath(), f"{inside}{name}/"))
            elif status.isFile() and wanted(inside + name):
                if largest is not None and status.getLen() > largest:
                    raise ValueError(f"{inside}{name} has {status.getLen()} bytes, more than {largest}")
                found.append((status.getPath().toString(), inside + name))
    return system, sorted(found, key=lambda x: x[1])


def scan(spark: SparkSession, root: str, run_id: str | None = None, largest: int | None = None) -> DataFrame:
    """``path, content`` of the claimed files below a folder, relative to it.

    Names come first and only claimed files are opened, by the executors, whatever
    their size; with ``largest`` a larger claimed file is an error. Files
    whose own name is hidden are few and small, and are read by the driver.
    """
    system, found = _listing(spark, root, largest)
    plain = [(p, i) for p, i in found if not i.rpartition("/")[2].startswith((".", "_"))]
    hidden = [(p, i) for p, i in found if i.rpartition("/")[2].startswith((".", "_"))]
    jvm, rows = spark._jvm, []
    for path, inside in hidden:
        stream = system.open(jvm.org.apache.hadoop.fs.Path(path))
        rows.append((inside, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
    out = spark.createDataFrame(rows, "path string, content binary")
    if plain:
        names = spark.createDataFrame(plain, "path string, inside string")
        read = spark.read.format("binaryFile").load([p for p, _ in plain]).select("path", "content")
        out = out.unionByName(read.join(F.broadcast(names), "path").select(F.col("inside").alias("path"), "content"))
    return out.withColumn("run_id", F.lit(run_id)) if run_id is not None else out


def static(spark: SparkSession, files: dict[str, str | bytes], run_id: str | None = None) -> DataFrame:
    """In-memory files, in order of path."""
    rows = [(p, c.encode() if isinstance(c, str) else c) for p, c in sorted(files.items())]
    out = spark.createDataFrame(rows, "path string, content binary")
    return out.withColumn("run_id", F.lit(run_id)) if run_id is not None else out


def at_commit(snapshots: DataFrame, commit: str) -> DataFrame:
    """One tree of ``snapshots(commit, path, content)``; an unknown commit is an
    error that names the closest ones."""
    rows = snapshots.where(F.col("commit") == commit)
    if rows.limit(1).count() == 0:
        near = snapshots.select("commit").distinct().orderBy(F.levenshtein("commit", F.lit(commit)), "commit").limit(3)
        raise LookupError(f"no commit {commit!r}; did you mean {', '.join(r['commit'] for r in near.collect())}?")
    return rows.select("path", "content")
