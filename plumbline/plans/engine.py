"""The commands as methods over one store: scan, audit, risk, report, org,
history, projects, clean, tools."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import purl as P
from plumbline.functions.scalars import error_kind, severity_rank
from plumbline.operators import controls as C
from plumbline.operators import findings as FI
from plumbline.operators import fleet as FL
from plumbline.operators import graph as G
from plumbline.operators import observations as O
from plumbline.operators import posture as PO
from plumbline.operators import rollup as R
from plumbline.operators import score as SC
from plumbline.operators.workspace import cut
from plumbline.plans.walk import Bounds, walk
from plumbline.sources import extractors, files, lockfiles, toolbox
from plumbline.sources.store import Store


#: Files at the root of a tree whose content decides what is installed.
WATCHED = (
    "package.json", "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "pyproject.toml", "requirements.txt", "poetry.lock",
    "uv.lock", "Pipfile", "Pipfile.lock", "pdm.lock", "setup.py", "setup.cfg", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "Gemfile", "Gemfile.lock",
    "composer.json", "composer.lock", "pom.xml", "build.gradle", "build.gradle.kts",
)


@dataclass
class Registry:
    """Pre-staged registry and observation tables; any may be missing."""

    versions: DataFrame | None = None
    requirements: DataFrame | None = None
    advisory_matches: DataFrame | None = None  # node_id, osv_id
    advisories: DataFrame | None = None
    facts: DataFrame | None = None
    projects: DataFrame | None = None


@dataclass
class Report:
    """Sections of a report: small frames, and the score's single row."""

    run_id: str
    exposure: DataFrame
    findings: DataFrame
    actions: DataFrame
    signals: DataFrame
    controls: DataFrame
    coverage: DataFrame
    introducers: DataFrame
    plan: DataFrame
    pinning: DataFrame
    owners: DataFrame
    score: dict = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, store: str, registry: Registry | None = None):
        self.spark, self.store, self.registry = spark, Store(spark, store), registry or Registry()

    def _or_empty(self, frame: DataFrame | None, schema: str) -> DataFrame:
        return frame if frame is not None else self.spark.createDataFrame([], schema)

    # --- scan -------------------------------------------------------------------

    def scan(self, source: str | DataFrame, target: str, ref: str = "", bounds: Bounds = Bounds(), run_id: str | None = None, project_num: int | None = None, now: datetime | None = None) -> str:
        """Files to a stored run: extract, read lockfiles, walk, merge, roll up."""
        run_id = run_id or uuid.uuid4().hex[:16]
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        rows = cut(files.scan(self.spark, source) if isinstance(source, str) else source.select("path", "content"))
        root = f"pkg:generic/{target}@{ref or 'head'}"
        roots = self.spark.createDataFrame([(root,)], "id string")
        edges, nodes = extractors.edges_and_nodes(cut(extractors.extract(rows)), roots)
        installed = cut(lockfiles.read(rows).where("error IS NULL").select("locator", "node_id", "parent_locator", "derived_from"))
        pins = R.pins(installed)
        versions = self._or_empty(self.registry.versions, "ecosystem string, name string, version string, published_at timestamp")
        requirements = self._or_empty(self.registry.requirements, "ecosystem string, name string, version string, dep_name string, spec string, scope string")
        closure = walk(nodes.drop("run_id"), edges, root, versions, requirements, bounds, pins)
        lock_nodes, lock_edges = R.merge_instances(installed, roots)
        every = closure.nodes.withColumn("ord", F.lit(0)).unionByName(lock_nodes.withColumn("ord", F.lit(1)), allowMissingColumns=True)
        all_nodes = cut(G.upsert_nodes(every).drop("ord"))
        all_edges = cut(G.dedupe_edges(closure.edges.unionByName(lock_edges)))
        placed = cut(all_edges.select(F.lit(run_id).alias("run_id"), "from_id", "to_id", F.lit(root).alias("root")))
        paths = cut(G.run_metrics(placed).select("id", "paths"))
        versions_rolled = cut(R.version_rollup(all_nodes, all_edges, installed, paths))
        packages = R.package_rollup(all_nodes, all_edges, versions_rolled, paths, roots)
        run = {
            "run_id": run_id, "target": target, "ref": ref, "mode": bounds.mode, "as_of": bounds.as_of, "known_at": None, "created_at": now,
            "bounds_json": json.dumps(asdict(bounds) | {"as_of": str(bounds.as_of), "root": root, "depth": closure.depth, "hit": closure.bounds_hit}), "project_num": project_num,
        }
        self.store.write_run(run, nodes=all_nodes, edges=all_edges, instances=installed, package_rollup=packages, version_rollup=versions_rolled)
        return run_id

    def _run(self, ref: str) -> tuple[str, dict[str, DataFrame]]:
        run_id = self.store.resolve(ref)
        return run_id, {t: cut(self.store.read(t).where(F.col("run_id") == run_id).drop("run_id")) for t in ("nodes", "edges", "instances", "version_rollup")}

    # --- audit and risk -----------------------------------------------------------

    def targets(self, run: dict[str, DataFrame], state: str | None = None) -> DataFrame:
        rows = run["version_rollup"]
        return (rows.where(F.col("state") == state) if state else rows).select("node_id").distinct()

    def findings(self, targets: DataFrame, known_at: datetime | None = None) -> DataFrame:
        matches = self._or_empty(self.registry.advisory_matches, "node_id string, osv_id string").join(targets, "node_id", "left_semi")
        records = self._or_empty(self.registry.advisories, "osv_id string, summary string, severity string, published timestamp, withdrawn timestamp, aliases array<string>")
        return FI.check(matches, records, F.lit(known_at).cast("timestamp"))

    def audit(self, ref: str, state: str | None = None, known_at: datetime | None = None) -> DataFrame:
        """Findings of a run's versions, worst first; nothing to audit is an error."""
        _, run = self._run(ref)
        targets = self.targets(run, state)
        if targets.limit(1).count() == 0:
            raise LookupError("the run has no package versions to audit")
        return FI.ordered(self.findings(targets, known_at))

    def risk(self, ref: str, known_at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        """Posture signals, and the cross-check of advisories with the facts.
        Posture is current only, so a past knowledge time is refused."""
        if known_at is not None:
            raise ValueError("posture cannot be reconstructed for a past time")
        _, run = self._run(ref)
        targets = self.targets(run)
        facts = self.registry.facts.join(targets, "node_id", "left_semi")
        signals = PO.assess(facts, self.registry.projects)
        other = facts.select("node_id", F.explode("advisory_ids").alias("osv_id"))
        return PO.signal_counts(signals), FI.cross_check(self.findings(targets), other)

    # --- report --------------------------------------------------------------------

    def report(self, ref: str, state: str | None = None, known_at: datetime | None = None, plan_depth: int = 5) -> Report:
        run_id, run = self._run(ref)
        nodes, edges, rolled = run["nodes"], run["edges"], run["version_rollup"]
        targets = cut(self.targets(run, state))
        findings = cut(self.findings(targets, known_at))
        named = cut(FI.surfaces(edges))
        refs = nodes.where(P.is_action("id")).select(F.col("id").alias("node_id"))
        actions = cut(FI.action_findings(self.findings(refs, known_at)))
        empty_facts = "node_id string, queried boolean, known boolean, deprecated boolean, deprecated_reason string, licenses array<string>, advisory_ids array<string>, attested boolean, source_repo string, provenance string"
        facts = self._or_empty(self.registry.facts, empty_facts).join(targets, "node_id", "left_semi")
        projects = self._or_empty(self.registry.projects, "project_id string, has_scorecard boolean, checks map<string, struct<score: int, reason: string, warnings: array<string>>>")
        signals = cut(PO.assess(facts, projects))
        found = cut(C.detect(nodes))
        affected = findings.select(F.col("node_id").alias("id")).distinct()
        direct = named.select("id").where(P.is_package("id")).distinct()
        pairs = cut(G.attribution(direct, affected, G.package_edges(edges)))
        report = Report(
            run_id, exposure=FI.exposure(targets, findings, named), findings=FI.ordered(findings), actions=actions, signals=PO.signal_counts(signals), controls=found,
            coverage=FI.coverage(nodes), introducers=G.introducers(pairs), plan=G.greedy_plan(pairs, plan_depth), pinning=R.pinning_counts(rolled),
            owners=FI.by_owner(findings, FI.node_owners(run["instances"], edges)),
        )
        report.score = self._score(nodes, targets, findings, actions, signals, found, rolled)
        return report

    def _score(self, nodes, targets, findings, actions, signals, found, rolled) -> dict:
        """The score's inputs come from the report's own sections, so they agree."""
        n, label = F.count_if, F.col("label")
        counted = findings.agg(n(label == "MALICIOUS").alias("malicious"), n(label == "CRITICAL").alias("critical"), n(label == "HIGH").alias("high"), n(label == "MODERATE").alias("moderate"))
        worst = actions.groupBy("node_id").agg(F.max(severity_rank(label)).alias("r"))
        acted = worst.agg(n(F.col("r") >= 4).alias("action_critical"), n(F.col("r") == 3).alias("action_high"), n(F.col("r") == 2).alias("action_moderate"))
        held = rolled.agg(*[n(F.col("pinning") == p).alias(p) for p in ("floating", "pinned", "locked")])
        code = F.col("code")
        posture = signals.agg(n(code == "unmaintained").alias("unmaintained"), n(code == "dangerous-workflow").alias("dangerous_workflow"), n(code == "unreviewed-code").alias("unreviewed_code"))
        share = FI.auditable(nodes, targets).select(
            F.coalesce("targets", F.lit(0)).alias("checked"), F.col("action_nodes").alias("actions_checked"), F.col("actions_moving").alias("actions_floating"), (F.col("action_nodes") - F.col("actions_moving")).alias("actions_pinned"), "surface", "auditable"
        )
        control = C.missing(found).agg(F.count(F.lit(1)).alias("controls_missing")).withColumn("controls_total", F.lit(len(C.KINDS)))
        able = C.assessable(nodes).select(F.col("assessable").alias("controls_assessable"))
        row = share
        for part in (counted, acted, held, posture, control, able):
            row = row.crossJoin(part)  # one row each
        return SC.score(row).first().asDict(recursive=True)

    # --- fleet, history, housekeeping ------------------------------------------------

    def org(self, targets: list[tuple[str, str | DataFrame]], bounds: Bounds = Bounds(), resume: bool = True, workers: int = 4) -> tuple[DataFrame, DataFrame]:
        """Scan repositories (skipping those that have a run), ``workers`` at a time,
        then fold them. Failures are rows with their kind: one bad repository does not
        stop a fleet."""
        done = {r["target"] for r in self.store.read("runs").select("target").distinct().collect()} if resume and self.store.exists("runs") else set()

        def one(target: tuple[str, str | DataFrame]) -> tuple[str, str | None]:
            name, source = target
            if name in done:
                return name, None
            try:
                self.scan(source, name, bounds=bounds)
            except Exception as e:
                return name, f"{type(e).__name__}: {e}"
            return name, None

        with ThreadPoolExecutor(workers) as pool:
            rows = list(pool.map(one, targets))
        status = self.spark.createDataFrame(rows, "target string, error string").withColumn("kind", F.when(F.col("error").isNotNull(), error_kind(F.col("error"))))
        latest = O.latest_runs(self.store.read("runs"), "target").select("run_id", "target")
        return status, self.fleet(latest)

    def fleet(self, runs: DataFrame, known_at: datetime | None = None) -> DataFrame:
        """Exposure totals over runs as known at a time: every grouping keys on
        run_id, no loop."""
        rolled = self.store.read("version_rollup").join(runs.select("run_id"), "run_id", "left_semi")
        edges = self.store.read("edges").join(runs.select("run_id"), "run_id", "left_semi")
        targets = rolled.select("run_id", "node_id").distinct()
        matches = self._or_empty(self.registry.advisory_matches, "node_id string, osv_id string")
        records = self._or_empty(self.registry.advisories, "osv_id string, summary string, severity string, published timestamp, withdrawn timestamp, aliases array<string>")
        found = FI.check(targets.join(matches, "node_id"), records, F.lit(known_at).cast("timestamp"))
        return FL.exposure_totals(FI.exposure(targets, found, FI.surfaces(edges)))

    def history(self, snapshots: DataFrame, package: str | None = None) -> DataFrame:
        """Dependency movement over ``commit_ord, path, content``, by graph position.
        Trees whose watched files (``WATCHED``, at the root) did not change are passed
        over; what moved is read from npm manifests and lockfiles at any depth."""
        watched = snapshots.where(F.col("path").isin(*WATCHED))
        digest = watched.groupBy("commit_ord").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.sha2("content", 256)))), "\n"), 256).alias("digest"))
        picked = O.history_candidates(digest)
        rank = F.row_number().over(Window.orderBy("commit_ord"))  # commits of one repository
        order = picked.select("commit_ord", (rank - 1).alias("place"))
        npm = snapshots.where(F.col("path").rlike(r"(^|/)(package\.json|package-lock\.json)$"))
        rows = cut(npm.join(order, "commit_ord").select(F.col("place").cast("string").alias("run_id"), "path", "content"))
        declared = extractors.extract(rows).where("extractor = 'npm-manifest'").groupBy("run_id", P.purl_name("to_id").alias("name")).agg(F.max("spec").alias("declared"))
        held = lockfiles.read(rows).where("error IS NULL").groupBy("run_id", P.purl_name("node_id").alias("name")).agg(F.max(P.purl_version("node_id")).alias("installed"))
        both = declared.join(held, ["run_id", "name"], "left").withColumn("commit_ord", F.col("run_id").cast("int")).drop("run_id")
        changes = O.history_changes(both)
        changes = changes.join(order.withColumnsRenamed({"commit_ord": "commit", "place": "commit_ord"}), "commit_ord").drop("commit_ord")
        return changes.where(F.col("name") == package) if package else changes

    def projects(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        runs = self.store.read("runs").select("run_id", F.col("project_num").alias("project"), "created_at")
        listed = self.store.read("projects")
        paths = self.store.read("project_paths") if self.store.exists("project_paths") else self.spark.createDataFrame([], "num int, path string")
        return O.projects_listing(listed, runs, paths, prefix, limit)

    def clean(self, keep: int | None = None, older_than: datetime | None = None, unclaimed: bool = False, dry_run: bool = True) -> list[str]:
        runs = self.store.read("runs").withColumn("project", F.col("project_num"))
        plan = O.prune_plan(runs, keep, F.lit(older_than).cast("timestamp") if older_than else None, unclaimed=unclaimed)
        return self.store.drop_runs(plan, dry_run)

    def tools(self) -> DataFrame:
        return toolbox.catalogue(self.spark)
