"""The store: Parquet folders, one lifetime each, runs published last.

``runs/`` is the commit marker of a run: its derived tables lie under
``run_id=`` partitions and are only visible through it. Observations are only
ever appended, and read through latest-of-key views. Dropping a run removes its
derived partitions and never an observation.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import observations as O
from plumbline.operators.workspace import cut

VERSION = 5
DERIVED = ("nodes", "edges", "instances", "package_rollup", "version_rollup")
OBSERVATIONS = ("packument_obs", "ref_obs", "depsdev_obs", "scorecard_obs", "version_facts", "advisories", "advisory_affects")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._appending = threading.Lock()
        self._recover()
        marker = self._path("_version")
        found = self._fs(marker).exists(marker)
        version = self.spark.read.text(str(marker)).first()[0] if found else None
        if version is None or int(version) < VERSION:
            # folders read with mergeSchema, so older ones only need the marker
            self.spark.createDataFrame([(str(VERSION),)], "value string").coalesce(1).write.mode("overwrite").text(str(marker))
        elif int(version) > VERSION:
            raise RuntimeError(f"store version {version} is newer than {VERSION}")

    def _recover(self) -> None:
        """Put back tables whose replacement was interrupted (see _replace())."""
        folder = self._path("_replaced")
        if self._fs(folder).exists(folder):
            for status in self._fs(folder).listStatus(folder):
                table = self._path(status.getPath().getName())
                if self._fs(table).exists(table):
                    self._fs(folder).delete(status.getPath(), True)
                else:
                    self._fs(folder).rename(status.getPath(), table)

    def _replace(self, table: str, rows: DataFrame, files: int | None = None) -> None:
        """Write a table beside the old one, then swap folders: at every moment
        either the old or the new rows are whole, here or in ``_replaced``."""
        new, now, old = self._path(f"_new_{uuid.uuid4().hex}"), self._path(table), self._path("_replaced", table)
        (rows.coalesce(files) if files else rows).write.parquet(str(new))
        fs = self._fs(now)
        if fs.exists(now):
            fs.mkdirs(old.getParent())
            fs.delete(old, True)
            fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        path = self._path(table)
        return self._fs(path).exists(path)

    def read(self, table: str) -> DataFrame:
        """A table; derived ones only show runs that were published."""
        if not self.exists(table):
            raise LookupError(f"the store has no {table}")
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}")
        if table in DERIVED:
            rows = rows.withColumn("run_id", F.col("run_id").cast("string")).join(self.read("runs").select("run_id"), "run_id", "left_semi")
        return rows

    def write_run(self, run: dict, **tables: DataFrame) -> None:
        """All derived tables of a run, then its row in ``runs``."""
        unknown = set(tables) - set(DERIVED)
        if unknown:
            raise ValueError(f"not derived tables: {sorted(unknown)}")
        for name, rows in tables.items():
            if name == "edges":
                rows = rows.dropDuplicates(["from_id", "to_id", "kind", "spec", "scope"])
            rows.drop("run_id").write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run['run_id']}")
        fields = "run_id string, target string, ref string, mode string, as_of timestamp, known_at timestamp, created_at timestamp, bounds_json string, project_num int"
        row = self.spark.createDataFrame([tuple(run.get(f.split()[0]) for f in fields.split(", "))], fields).coalesce(1)
        with self._appending:  # two appends to one folder would clear each other's temporary files
            row.write.mode("append").parquet(f"{self.root}/runs")

    def append(self, table: str, rows: DataFrame) -> None:
        if table not in OBSERVATIONS:
            raise ValueError(f"not an observation table: {table}")
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def latest(self, table: str, keys: list[str], at: str = "observed_at") -> DataFrame:
        return O.latest(self.read(table), keys, at)

    def counts(self) -> DataFrame:
        """Rows of every observation table; what pruning must leave alone."""
        out = None
        for table in OBSERVATIONS:
            n = self.spark.read.parquet(f"{self.root}/{table}").agg(F.count(F.lit(1)).alias("n")) if self.exists(table) else self.spark.createDataFrame([(0,)], "n long")
            row = n.select(F.lit(table).alias("table"), "n")
            out = row if out is None else out.unionByName(row)
        return out

    def drop_runs(self, doomed: DataFrame, dry_run: bool = False) -> list[str]:
        """Remove runs: their row first, then their partitions."""
        ids = sorted(r["run_id"] for r in doomed.select("run_id").distinct().collect())  # a plan over runs, not data
        if not ids:
            raise ValueError("the selection is empty")
        if dry_run:
            return ids
        before = self.counts().collect()
        left = cut(self.read("runs").where(~F.col("run_id").isin(ids)))
        self._replace("runs", left)
        for table in DERIVED:
            for run_id in ids:
                path = self._path(table, f"run_id={run_id}")
                self._fs(path).delete(path, True)
        if self.counts().collect() != before:
            raise AssertionError("pruning changed observations")
        return ids

    def compact(self, table: str, files: int = 1) -> None:
        """Rewrite an observation table in few files."""
        rows = cut(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}"))
        self._replace(table, rows, files)

    def upsert_projects(self, new: DataFrame) -> DataFrame:
        fields = "key string, num int, name string, created_at timestamp"
        old = cut(self.spark.read.parquet(f"{self.root}/projects")) if self.exists("projects") else self.spark.createDataFrame([], fields)
        rows = cut(O.upsert_projects(old, new))
        self._replace("projects", rows, 1)
        return rows

    def resolve(self, ref: str) -> str:
        """A run from its id, or the newest of a project by number, name or
        unique part of its key; ambiguity is an error that lists candidates."""
        runs = self.read("runs")
        if runs.where(F.col("run_id") == ref).limit(1).count():
            return ref
        hits = runs.where(F.col("target") == ref).select(F.col("target").alias("t")).distinct()
        projects = self.read("projects") if self.exists("projects") else None
        if projects is not None:
            rows = projects.where(F.col("num").cast("string") == ref)
            if rows.limit(1).count() == 0:
                rows = projects.where(F.col("name") == ref)
            if rows.limit(1).count() == 0:
                rows = projects.where(F.col("key").contains(ref) | F.col("name").contains(ref))
            found = rows.orderBy("num").limit(6).collect()
            if len(found) > 1:
                raise LookupError(f"{ref!r} is ambiguous: " + ", ".join(f"{r['num']} {r['key']}" for r in found))
            if found:
                newest = runs.where(F.col("project_num") == found[0]["num"]).orderBy(F.desc("created_at"), F.desc("run_id")).first()
                if newest is not None:
                    return newest["run_id"]
        if hits.limit(1).count():
            return runs.where(F.col("target") == ref).orderBy(F.desc("created_at"), F.desc("run_id")).first()["run_id"]
        raise LookupError(f"no run or project {ref!r}")
