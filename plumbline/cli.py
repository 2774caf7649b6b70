"""Command line: ``python -m plumbline.cli COMMAND ...`` over a store folder."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import findings as FI
from plumbline.plans.engine import Engine, Registry, Report
from plumbline.plans.walk import Bounds
from plumbline.sources import emit

TABLES = ("versions", "requirements", "advisory_matches", "advisories", "facts", "projects")


def when(text: str) -> datetime:
    """RFC 3339 or a date, as UTC."""
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment.replace(tzinfo=None) if moment.tzinfo is None else moment.astimezone(tz=None).replace(tzinfo=None)


def lines(title: str, df: DataFrame, limit: int = 20) -> str:
    """A section: its title and at most ``limit`` rows, and how many more."""
    rows = df.limit(limit + 1).collect()
    text = [title] + ["  " + "  ".join("-" if v is None else str(v) for v in r) for r in rows[:limit]]
    return "\n".join(text + (["  ..."] if len(rows) > limit else [])) + "\n"


def render(r: Report) -> str:
    s = r.score
    head = f"RISK  NOT GRADED\n  {s['reason']}" if s["suppressed"] else f"RISK  {s['grade']}  ({s['score']}/100, higher is worse)\n  {s['reason']}".rstrip()
    points = "\n".join(f"  {k:<16}{v:6.1f}" for k, v in s["points"].items())
    share = f"  {int(s['auditable'] * 100 + 0.5)}% of {s['surface']} dependencies were auditable"
    parts = [
        lines("EXPOSURE  reach, surface, checked, affected, malicious, critical, high, other", r.exposure),
        lines("ADVISORIES  node, id, severity", r.findings.select("node_id", "osv_id", "label")),
        lines("ACTIONS (matched by name)  action, ref, id", r.actions.select("action", "ref", "osv_id")),
        lines("INTRODUCERS  direct, affected, exclusive", r.introducers.orderBy("affected", ascending=False)),
        lines("UPGRADE PLAN  step, direct, affected, newly cleared", r.plan.orderBy("step")),
        lines("POSTURE  signal, versions, projects", r.signals.orderBy("ord").select("code", "versions", "projects")),
        lines("CONTROLS  kind, tool", r.controls.select("kind", "tool").orderBy("kind", "tool")),
        lines("OWNERS  owner, malicious, critical, high, other", r.owners),
        lines("FRONTIER  reason, nodes", r.coverage.orderBy("n", ascending=False)),
    ]
    return f"{head}\n{points}\n{share}\n\n" + "\n".join(parts)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--store", default="plumbline-store")
    p.add_argument("--registry", help="folder with " + ", ".join(f"{t}/" for t in TABLES) + " as Parquet")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("source")
    scan.add_argument("--target")
    scan.add_argument("--ref", default="")
    scan.add_argument("--mode", choices=("will", "can"), default="will")
    scan.add_argument("--as-of", type=when)
    for name in ("audit", "risk", "report"):
        s = sub.add_parser(name)
        s.add_argument("run")
        s.add_argument("--known-at", type=when)
        s.add_argument("--state", choices=("installed", "possible", "unknown"))
        s.add_argument("--format", choices=("text", "json", "cyclonedx", "mermaid"), default="text")
    org = sub.add_parser("org")
    org.add_argument("folders", nargs="+")
    org.add_argument("--workers", type=int, default=4)
    history = sub.add_parser("history", help="movement over snapshots: Parquet of commit_ord, path, content")
    history.add_argument("snapshots")
    history.add_argument("--package")
    projects = sub.add_parser("projects")
    projects.add_argument("--prefix", default="")
    projects.add_argument("--limit", type=int)
    clean = sub.add_parser("clean")
    clean.add_argument("--keep", type=int)
    clean.add_argument("--older-than", type=when)
    clean.add_argument("--unclaimed", action="store_true")
    clean.add_argument("--apply", action="store_true")
    sub.add_parser("tools")
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    tables = {}
    for t in TABLES if a.registry else ():
        try:
            tables[t] = spark.read.parquet(f"{a.registry}/{t}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    engine = Engine(spark, a.store, Registry(**tables))
    if a.command == "scan":
        target = a.target or a.source.rstrip("/").rpartition("/")[2]
        print(engine.scan(a.source, target, a.ref, Bounds(mode=a.mode, as_of=a.as_of)))
    elif a.command == "audit":
        print(lines("FINDINGS  node, id, severity, summary", engine.audit(a.run, a.state, a.known_at).select("node_id", "osv_id", "label", "summary"), 1000), end="")
    elif a.command == "risk":
        signals, check = engine.risk(a.run, a.known_at)
        print(lines("SIGNALS  signal, versions, projects", signals.orderBy("ord").select("code", "versions", "projects")) + lines("CROSS-CHECK  agreed, advisories only, facts only", check), end="")
    elif a.command == "report":
        print(_document(engine, a), end="")
    elif a.command == "org":
        status, totals = engine.org([(f.rstrip("/").rpartition("/")[2], f) for f in a.folders], workers=a.workers)
        print(lines("REPOSITORIES  target, error, kind", status, 1000) + lines("EXPOSURE", totals), end="")
    elif a.command == "history":
        moved = engine.history(spark.read.parquet(a.snapshots), a.package).orderBy("commit", "name")
        print(lines("HISTORY  commit, package, kind, declared from and to, installed from and to", moved.select("commit", "name", "kind", "from_declared", "to_declared", "from_installed", "to_installed"), 1000), end="")
    elif a.command == "projects":
        print(lines("PROJECTS  number, key, name, runs, newest, paths", engine.projects(a.prefix, a.limit), 1000), end="")
    elif a.command == "clean":
        print("\n".join(engine.clean(a.keep, a.older_than, a.unclaimed, dry_run=not a.apply)))
    else:
        print(lines("TOOLS  tool, category", engine.tools(), 1000), end="")
    return 0


def _document(engine: Engine, a: argparse.Namespace) -> str:
    if a.format in ("text", "json"):
        r = engine.report(a.run, a.state, a.known_at)
        if a.format == "text":
            return render(r)
        # every section is a page of a report, except the findings: one line for each
        parts = {f.name: [row.asDict(recursive=True) for row in part.toLocalIterator()] for f in fields(r) if isinstance(part := getattr(r, f.name), DataFrame)}
        return json.dumps({"run_id": r.run_id, "score": r.score} | parts, sort_keys=True, default=str) + "\n"
    run_id = engine.store.resolve(a.run)
    run = engine.store.read("runs").where(f"run_id = '{run_id}'").first()
    nodes, edges = (engine.store.read(t).where(f"run_id = '{run_id}'").drop("run_id") for t in ("nodes", "edges"))
    if a.format == "cyclonedx":
        root = json.loads(run["bounds_json"])["root"]
        return json.dumps(emit.cyclonedx({"root": root, "target": run["target"], "ref": run["ref"], "created_at": run["created_at"].isoformat() + "Z", "uuid": run_id}, nodes, edges), indent=1) + "\n"
    found = engine.findings(nodes.selectExpr("id AS node_id"), a.known_at)
    return emit.mermaid(emit.risk_map_rows(FI.surface_files(edges, nodes), found), run["target"])


if __name__ == "__main__":
    raise SystemExit(main())
