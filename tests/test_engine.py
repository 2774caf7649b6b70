import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.plans.engine import Engine, Registry
from plumbline.plans.walk import Bounds
from plumbline.sources import emit, files, registries

SOURCE = {
    "package.json": json.dumps({"dependencies": {"a": "^1.0.0"}}),
    ".github/workflows/ci.yml": "jobs:\n  b:\n    steps:\n      - uses: actions/checkout@v4\n      - run: trivy fs .\n",
    "Dockerfile": "FROM alpine:3.19\nRUN apk add curl=8.1\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    reg = Registry(
        versions=spark.createDataFrame([("npm", "a", "1.0.0", datetime(2020, 1, 1)), ("npm", "a", "1.1.0", datetime(2022, 1, 1)), ("npm", "b", "2.0.0", None), ("npm", "c", "3.0.0", None), ("npm", "x", "1.0.0", None)], "ecosystem string, name string, version string, published_at timestamp"),
        requirements=spark.createDataFrame([("npm", "a", "1.0.0", "b", "^2.0.0", "prod"), ("npm", "a", "1.1.0", "c", "^3.0.0", "prod"), ("npm", "c", "3.0.0", "a", "^1", "prod"), ("npm", "c", "3.0.0", "d", "^1", "dev")], "ecosystem string, name string, version string, dep_name string, spec string, scope string"),
        advisory_matches=spark.createDataFrame([("pkg:npm/c@3.0.0", "G1")], "node_id string, osv_id string"),
        advisories=spark.createDataFrame([("G1", "bad", "HIGH", datetime(2024, 1, 1), None, ["CVE-1"])], "osv_id string, summary string, severity string, published timestamp, withdrawn timestamp, aliases array<string>"),
    )
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), reg)
    e.scan(files.static(spark, SOURCE), "app", run_id="will")
    return e


def ids(engine, run):
    return {r["id"]: r["reason"] for r in engine.store.read("nodes").where(F.col("run_id") == run).collect()}


def test_will_takes_one_version_and_skips_dev(engine):
    got = ids(engine, "will")
    assert {k for k in got if k.startswith("pkg:npm/")} == {"pkg:npm/a@1.1.0", "pkg:npm/c@3.0.0", "pkg:npm/d"} and got["pkg:npm/d"] == "dev-not-installed"


def test_can_is_a_superset(engine, spark):
    engine.scan(files.static(spark, {"package.json": SOURCE["package.json"]}), "can", run_id="can", bounds=Bounds(mode="can"))
    assert {"pkg:npm/a@1.0.0", "pkg:npm/a@1.1.0", "pkg:npm/b@2.0.0", "pkg:npm/c@3.0.0"} <= set(ids(engine, "can"))


def test_as_of_and_depth_bounds(engine, spark):
    engine.scan(files.static(spark, {"package.json": SOURCE["package.json"]}), "old", run_id="old", bounds=Bounds(as_of=datetime(2021, 1, 1)))
    assert "pkg:npm/a@1.0.0" in ids(engine, "old") and "pkg:npm/a@1.1.0" not in ids(engine, "old")
    engine.scan(files.static(spark, {"package.json": SOURCE["package.json"]}), "shallow", run_id="shallow", bounds=Bounds(max_depth=1))
    assert ids(engine, "shallow")["pkg:npm/c"] == "bound:depth"


def test_report_sections_agree(engine):
    r = engine.report("app")
    assert {(x["node_id"], x["label"]) for x in r.findings.collect()} == {("pkg:npm/c@3.0.0", "HIGH")}
    assert [(x["direct"], x["affected"]) for x in r.introducers.collect()] == [("pkg:npm/a@1.1.0", 1)]
    assert {x["tool"] for x in r.controls.collect()} == {"Trivy"} and r.score["high"] == 1 and r.score["controls_missing"] == 8 and r.score["grade"]
    assert engine.audit("will").count() == 1 and engine.audit("will", known_at=datetime(2023, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        engine.risk("will", known_at=datetime(2023, 1, 1))


def test_documents(engine):
    nodes, edges = (engine.store.read(t).where("run_id = 'will'") for t in ("nodes", "edges"))
    root = "pkg:generic/app@head"
    doc = emit.cyclonedx({"root": root, "target": "app", "created_at": "2024-01-01T00:00:00Z", "uuid": "0"}, nodes, edges)
    refs = {c["bom-ref"] for c in doc["components"]} | {root}
    assert doc["specVersion"] == "1.6" and all(set(d["dependsOn"]) <= refs and d["ref"] in refs for d in doc["dependencies"])
    assert not any("opaque@" in c["bom-ref"] for c in doc["components"]) and json.dumps(doc) == json.dumps(emit.cyclonedx({"root": root, "target": "app", "created_at": "2024-01-01T00:00:00Z", "uuid": "0"}, nodes, edges))
    one = json.loads(emit.json_document(nodes, edges, ["run_id"]).first()["document"])
    assert [n["id"] for n in one["nodes"]] == sorted(n["id"] for n in one["nodes"]) and one["summary"]["nodes"] == len(one["nodes"])
    assert emit.json_lines(nodes, edges).count() == len(one["nodes"]) + len(one["edges"]) + 1


def test_clean_keeps_observations_and_org_resumes(engine, spark):
    engine.store.append("ref_obs", spark.createDataFrame([("r", datetime(2024, 1, 1), "x")], "ref_purl string, observed_at timestamp, resolved string"))
    status, totals = engine.org([("app", files.static(spark, SOURCE)), ("broken", "/no/such/folder")])
    assert {r["target"]: r["error"] is None for r in status.collect()} == {"app": True, "broken": False} and totals.count() > 0
    doomed = lambda: engine.store.read("runs").where("run_id = 'shallow'")
    assert engine.store.drop_runs(doomed(), dry_run=True) == ["shallow"] and engine.store.drop_runs(doomed()) == ["shallow"]
    assert not ids(engine, "shallow") and engine.store.read("ref_obs").count() == 1
    with pytest.raises(ValueError):
        engine.store.drop_runs(doomed())
    with pytest.raises(LookupError):
        engine.store.resolve("nothing")


def test_registries(spark):
    body = json.dumps({"name": "p", "time": {"1.0.0": "2020-01-01T00:00:00Z"}, "versions": {"1.0.0": {"dependencies": {"x": "^1"}, "devDependencies": {"y": "npm:z@2"}}, "2.0.0": {}}})
    versions, needs = registries.npm(spark.createDataFrame([(body,)], "body string"))
    assert {(r["version"], r["published_at"] is None) for r in versions.collect()} == {("1.0.0", False), ("2.0.0", True)}
    assert {(r["dep_name"], r["spec"], r["scope"]) for r in needs.collect()} == {("x", "^1", "prod"), ("z", "2", "dev")}
    body = json.dumps({"info": {"name": "P.q", "requires_dist": ["a-B (>=1) ; extra == 'x'", "c"]}, "releases": {"1": [{"upload_time_iso_8601": "2020-01-01T00:00:00Z", "yanked": False}], "2": [{"upload_time_iso_8601": "2021-01-01T00:00:00Z", "yanked": True}], "3": []}})
    versions, needs = registries.pypi(spark.createDataFrame([(body, "1")], "body string, version string"))
    assert {(r["name"], r["version"]) for r in versions.collect()} == {("p-q", "1")} and {(r["dep_name"], r["spec"], r["scope"]) for r in needs.collect()} == {("a-b", ">=1", "optional"), ("c", "", "prod")}
    lines = [json.dumps({"name": "k", "vers": "1.0.0", "yanked": False, "deps": [{"name": "r", "req": "^1", "kind": "normal", "optional": False, "package": "real"}, {"name": "t", "req": "1", "kind": "dev", "optional": False}]}), json.dumps({"name": "k", "vers": "2.0.0", "yanked": True, "deps": []})]
    versions, needs = registries.crates(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["version"] for r in versions.collect()] == ["1.0.0"] and [r["dep_name"] for r in needs.collect()] == ["real"]
    assert [spark.range(1).select(registries.crate_path(F.lit(n))).first()[0] for n in ("a", "ab", "Abc", "serde")] == ["1/a", "2/ab", "3/a/abc", "se/rd/serde"]
    mods = spark.createDataFrame([("m", "v1", "module m\nrequire (\n a.b/c v1.0.0\n d.e/f v2.0.0 // indirect\n)\nreplace a.b/c => ../c\n")], "module string, version string, value string")
    assert [(r["dep_name"], r["spec"]) for r in registries.go_requirements(mods).collect()] == [("a.b/c", "v1.0.0")]


def test_node_bound_cuts_inside_a_level(spark):
    from plumbline.plans.walk import EDGE, NODE, walk

    names = [f"p{i}" for i in range(10)]
    versions = spark.createDataFrame([("npm", n, "1.0.0", None) for n in [*names, "leaf"]], "ecosystem string, name string, version string, published_at timestamp")
    needs = spark.createDataFrame([("npm", n, "1.0.0", "leaf", "^1", "prod") for n in names], "ecosystem string, name string, version string, dep_name string, spec string, scope string")
    asked = spark.createDataFrame([("pkg:generic/app@1", f"pkg:npm/{n}", "depends_on", "^1", "prod", "declared") for n in names], EDGE)
    got = walk(spark.createDataFrame([], NODE), asked, "pkg:generic/app@1", versions, needs, Bounds(max_nodes=5))
    nodes = {r["id"]: (r["completeness"], r["reason"]) for r in got.nodes.where("ecosystem = 'npm'").collect()}
    resolved = sorted(k for k, v in nodes.items() if v[0] == "resolved")
    assert resolved == [f"pkg:npm/p{i}@1.0.0" for i in range(4)]  # the root is the fifth
    assert all(nodes[f"pkg:npm/p{i}@1.0.0"] == ("declared", "bound:nodes") for i in range(4, 10))
    assert nodes["pkg:npm/leaf"] == ("declared", "bound:nodes") and got.bounds_hit == ["bound:nodes"]
    whole = walk(spark.createDataFrame([], NODE), asked, "pkg:generic/app@1", versions, needs, Bounds(max_nodes=12))
    assert whole.nodes.where("completeness = 'resolved'").count() == 12 and not whole.bounds_hit


def test_interrupted_replacement_is_put_back(engine, spark):
    from plumbline.sources.store import Store

    before = engine.store.read("runs").count()
    root = engine.store.root
    import os

    os.makedirs(f"{root}/_replaced", exist_ok=True)
    os.rename(f"{root}/runs", f"{root}/_replaced/runs")  # stopped between the two renames
    assert Store(spark, root).read("runs").count() == before


def test_a_fleet_is_read_as_of_a_time(engine):
    runs = engine.store.read("runs").where("run_id = 'will'").select("run_id")
    hits = lambda at: engine.fleet(runs, at).agg({"affected": "sum"}).first()[0]
    assert hits(None) == 1 and hits(datetime(2023, 1, 1)) == 0


def test_history_watches_the_root_of_any_ecosystem(engine, spark):
    package = lambda spec: json.dumps({"dependencies": {"a": spec}}).encode()
    rows = [(0, "package.json", package("^1")), (1, "package.json", package("^1")), (1, "README.md", b"x"), (2, "package.json", package("^1")), (2, "sub/package.json", package("^9")), (3, "package.json", package("^2")), (3, "go.mod", b"module m\n")]
    got = engine.history(spark.createDataFrame([(c, p, bytearray(x)) for c, p, x in rows], "commit_ord int, path string, content binary")).collect()
    assert {(r["commit"], r["kind"], r["to_declared"]) for r in got} == {(0, "added", "^1"), (3, "range-changed", "^2")}
