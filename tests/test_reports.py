from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import purl as P
from plumbline.functions import scalars as S
from plumbline.operators import controls as C
from plumbline.operators import findings as FI
from plumbline.operators import fleet as FL
from plumbline.operators import observations as O
from plumbline.operators import posture as PO
from plumbline.operators import rollup as R
from plumbline.operators import score as SC


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# --- scores ------------------------------------------------------------------


def scored(spark, **values):
    base = dict.fromkeys(SC.INPUTS, 0) | {"checked": 100, "surface": 100, "auditable": 1.0, "controls_assessable": True, "controls_total": 9} | values
    row = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'double' if k == 'auditable' else 'boolean' if k == 'controls_assessable' else 'long'}" for k in base))
    return SC.score(row).first()


def test_score_invariants(spark):
    assert scored(spark)["score"] == 0 and scored(spark)["grade"] == "A"
    assert scored(spark, malicious=1)["grade"] == "F" and scored(spark, malicious=1)["score"] == 100
    one_, two = scored(spark, critical=1)["points"]["vulnerabilities"], scored(spark, critical=2)["points"]["vulnerabilities"]
    assert 0 < one_ < two <= 45
    assert scored(spark, critical=100)["points"]["vulnerabilities"] == 45
    package, action = scored(spark, critical=1, checked=100), scored(spark, action_critical=1, actions_checked=100)
    assert action["points"]["vulnerabilities"] == pytest.approx(package["points"]["vulnerabilities"] / 2)
    diluted = scored(spark, critical=1, checked=100, actions_checked=1000)
    assert diluted["points"]["vulnerabilities"] == package["points"]["vulnerabilities"]
    assert scored(spark, floating=10)["points"]["hygiene"] == 20 and scored(spark, floating=5, pinned=5)["points"]["hygiene"] == 10
    assert scored(spark, controls_missing=9)["points"]["controls"] == 20 and scored(spark, controls_missing=9, controls_assessable=False)["points"]["controls"] == 0
    assert scored(spark, dangerous_workflow=100)["points"]["posture"] == 15


def test_suppression_keeps_the_score(spark):
    empty, sparse = scored(spark, surface=0, floating=4, critical=1), scored(spark, auditable=0.2, critical=1)
    assert empty["suppressed"] and empty["grade"] is None and empty["score"] > 0 and "nothing to grade" in empty["reason"]
    assert sparse["suppressed"] and sparse["grade"] is None and sparse["reason"].startswith("only 20% of the 100")


# --- identities and labels -------------------------------------------------------


def test_purls(spark):
    lit = F.lit
    assert one(spark, P.purl(lit("npm"), lit("@types/node"), lit("1.0.0+b"))) == "pkg:npm/%40types/node@1.0.0%2Bb"
    assert one(spark, P.purl(lit("pypi"), lit("A__b.C"), lit(""))) == "pkg:pypi/a-b-c"
    for text, want in {"pkg:npm/%40t/n@1.0": ("@t/n", "1.0"), "pkg:golang/a.b/c@v1%2Bx": ("a.b/c", "v1+x"), "pkg:oci/i@sha256:ab?tag=1": ("i", "sha256:ab"), "pkg:github/o/r@v1#s/p": ("o/r", "v1"), "pkg:pypi/x": ("x", "")}.items():
        assert (one(spark, P.purl_name(lit(text))), one(spark, P.purl_version(lit(text)))) == want
    assert one(spark, P.advisory_key(lit("pkg:terraform/a/b@1.0")))["key"] == "pkg:golang/github.com/a/terraform-provider-b@v1.0"
    assert one(spark, P.advisory_key(lit("pkg:github/o/r@v1")))["ecosystem"] == "GitHub Actions"
    assert one(spark, P.is_package(lit("pkg:terraform-module/a/b"))) is False and one(spark, P.is_action(lit("pkg:github/o@x/y"))) is False
    assert one(spark, P.go_escape(lit("github.com/Az/B"))) == "github.com/!az/!b"
    for text, want in {"git@GitHub.com:O/r.git": "github.com/o/r", "https://u:p@h.io:8/A/b.git/": "h.io/a/b", "ssh://git@h/x/y": "h/x/y"}.items():
        assert one(spark, P.canonical_remote(lit(text)))["key"] == want
    assert one(spark, P.canonical_remote(lit("/local/path"))) is None


def test_labels(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    assert one(spark, S.severity_label(F.lit("X"), F.lit("LOW"), a("MAL-1"))) == "MALICIOUS" and one(spark, S.severity_label(F.lit("X"), F.lit(""), a())) == "UNKNOWN"
    assert one(spark, S.cve_of(F.lit("G"), a("Z", "CVE-2", "CVE-1"))) == "CVE-2" and one(spark, S.cve_of(F.lit("G"), a())) is None
    assert [one(spark, S.error_kind(F.lit(t))) for t in ("HTTP 404", "429 Too Many", "crates.io exploded")] == ["404", "ratelimit", "fetch"]


# --- findings ------------------------------------------------------------------


def test_dedupe_prefers_rated_records(spark):
    rows = spark.createDataFrame([("n", "GHSA-1", "HIGH", "s", ["CVE-1"]), ("n", "CVE-1", "", "s", []), ("n", "GHSA-2", "", "", [])], "node_id string, osv_id string, severity string, summary string, aliases array<string>")
    assert {r["osv_id"] for r in FI.dedupe(rows).collect()} == {"GHSA-1", "GHSA-2"}


def test_surfaces_and_exposure(spark):
    wf, dk = "pkg:generic/buildfile/workflow@1#ci.yml", "pkg:generic/buildfile/dockerfile@1#Dockerfile"
    e = spark.createDataFrame([("root", "pkg:npm/a@1", "^1"), ("root", "pkg:npm/b@1", ""), (dk, "pkg:npm/a@1", ""), ("pkg:npm/a@1", "pkg:npm/c@1", "^1"), (wf, "pkg:github/o/r@v1", "")], "from_id string, to_id string, spec string")
    named = FI.surfaces(e)
    assert {r["id"]: r["surfaces"] for r in FI.surface_sets(named).collect()} == {"pkg:npm/a@1": ["dockerfile", "manifest"], "pkg:github/o/r@v1": ["ci"]}
    targets = spark.createDataFrame([(f"pkg:npm/{x}@1",) for x in "abc"], "node_id string")
    found = spark.createDataFrame([("pkg:npm/a@1", "A", "HIGH"), ("pkg:npm/a@1", "B", "LOW"), ("pkg:npm/c@1", "C", "CRITICAL")], "node_id string, osv_id string, label string")
    got = {r["surface"]: (r["checked"], r["affected"], r["critical"], r["high"], r["other"]) for r in FI.exposure(targets, found, named).collect()}
    assert got == {"manifest": (1, 1, 0, 1, 1), "dockerfile": (1, 1, 0, 1, 1), "": (2, 1, 1, 0, 0), "ci": (0, 0, 0, 0, 0)} or got == {"manifest": (1, 1, 0, 1, 1), "dockerfile": (1, 1, 0, 1, 1), "": (2, 1, 1, 0, 0)}


def test_known_at_hides_later_and_withdrawn_records(spark):
    m = spark.createDataFrame([("n", "A"), ("n", "B"), ("n", "C"), ("n", "X")], "node_id string, osv_id string")
    d = datetime
    a = spark.createDataFrame([("A", "s", "LOW", d(2024, 1, 1), None, []), ("B", "s", "LOW", d(2024, 3, 1), None, []), ("C", "s", "LOW", d(2024, 1, 1), d(2024, 1, 5), [])], "osv_id string, summary string, severity string, published timestamp, withdrawn timestamp, aliases array<string>")
    assert {r["osv_id"] for r in FI.check(m, a, F.lit(d(2024, 2, 1))).collect()} == {"A"} and FI.check(m, a).count() == 3


# --- rollup, controls, posture, history -------------------------------------------


def test_pinning_and_states(spark):
    nodes = spark.createDataFrame([("pkg:npm/a@4.6.1", "npm", "a", "4.6.1"), ("pkg:npm/b@1.0.0", "npm", "b", "1.0.0"), ("pkg:npm/c@1.0.0", "npm", "c", "1.0.0"), ("pkg:pypi/r@4.6.1", "pypi", "r", "4.6.1"), ("pkg:pypi/r", "pypi", "r", "")], "id string, ecosystem string, name string, version string")
    edges = spark.createDataFrame([("x", "pkg:npm/a@4.6.1", "^4.5.0"), ("y", "pkg:npm/b@1.0.0", "^1.0.0"), ("z", "pkg:npm/b@1.0.0", "1.0.0"), ("x", "pkg:npm/c@1.0.0", "^1"), ("x", "pkg:pypi/r", ">4.5.0")], "from_id string, to_id string, spec string")
    held = spark.createDataFrame([("l1", "pkg:npm/a@4.6.1"), ("l2", "pkg:pypi/r@4.6.1")], "locator string, node_id string")
    rolled = R.version_rollup(nodes, edges, held, nodes.select("id", F.lit(1).alias("paths")))
    got = {r["node_id"]: (r["state"], r["pinning"], r["declared_spec"]) for r in rolled.collect()}
    assert got == {"pkg:npm/a@4.6.1": ("installed", "locked", "^4.5.0"), "pkg:npm/b@1.0.0": ("possible", "pinned", "1.0.0"), "pkg:npm/c@1.0.0": ("possible", "floating", "^1"), "pkg:pypi/r@4.6.1": ("installed", "locked", ">4.5.0")}
    none = R.version_rollup(nodes, edges, held.limit(0), nodes.select("id", F.lit(1).alias("paths")))
    assert {r["state"] for r in none.collect()} == {"unknown"}
    assert {(r["name"], r["version"]) for r in R.pins(held.union(spark.createDataFrame([("l3", "pkg:npm/a@5.0.0")], "l string, n string"))).collect()} == {("r", "4.6.1")}


def test_controls_count_runs_and_not_mentions(spark):
    rows = [
        ("pkg:github/GitHub/codeql-action@v3", "declared", None, None), ("pkg:generic/unanalysed/dependabot@1?category=bot", "declared", None, ".github/dependabot.yml"),
        ("pkg:generic/opaque@1", "opaque", "sudo CI=1 /usr/bin/trivy fs . | tee x", "ci.yml"), ("pkg:generic/opaque@2", "opaque", "echo semgrep; npm install audit", "ci.yml"), ("pkg:generic/opaque@3", "opaque", "cargo deny check", "b.yml"),
    ]
    nodes = spark.createDataFrame(rows, "id string, completeness string, note string, source string")
    got = {(r["kind"], r["tool"]): r["evidence"] for r in C.detect(nodes).collect()}
    assert got == {("sast", "CodeQL"): ["GitHub/codeql-action"], ("dependency-updates", "Dependabot"): [".github/dependabot.yml"], ("container", "Trivy"): ["ci.yml"], ("sca", "cargo-deny"): ["b.yml"]}
    assert C.missing(C.detect(nodes)).count() == 5 and C.assessable(nodes).first()["assessable"] is False


def test_posture_keeps_absences_apart(spark):
    facts = spark.createDataFrame(
        [("a", False, False, False, "", [], "", ""), ("b", True, False, False, "", [], "", ""), ("c", True, True, True, "", ["MIT"], "r1", "SLSA_ATTESTATION"), ("d", True, True, False, "", [], "r2", "X"), ("e", True, True, False, "", ["non-standard"], "", "")],
        "node_id string, queried boolean, known boolean, deprecated boolean, deprecated_reason string, licenses array<string>, source_repo string, provenance string",
    )
    checks = {"Maintained": (0, "idle", ["w"]), "Code-Review": (-1, "", []), "Pinned-Dependencies": (2, "", [])}
    projects = spark.createDataFrame([("r1", True, checks)], "project_id string, has_scorecard boolean, checks map<string, struct<score: int, reason: string, warnings: array<string>>>")
    got = {}
    for r in PO.assess(facts, projects).collect():
        got.setdefault(r["node_id"], set()).add(r["code"])
    assert got == {"b": {"unlisted"}, "c": {"deprecated", "unmaintained", "unpinned-upstream-build"}, "d": {"no-license", "unattested-source", "no-scorecard"}, "e": {"non-standard-license", "no-source-repo"}}


def test_history_kinds(spark):
    rows = [(0, "a", "^1.0.0", "1.0.5"), (1, "a", "^1.0.0", "1.0.7"), (1, "b", "1", None), (2, "a", "^1.1.0", "1.1.0")]
    got = {(r["commit_ord"], r["name"], r["kind"]) for r in O.history_changes(spark.createDataFrame(rows, "commit_ord int, name string, declared string, installed string")).collect()}
    assert got == {(0, "a", "added"), (1, "a", "version-changed"), (1, "b", "added"), (2, "a", "range-changed"), (2, "b", "removed")}


def test_prune_refuses_an_empty_selection(spark):
    runs = spark.createDataFrame([(str(i), "p", datetime(2024, 1, i + 1)) for i in range(4)], "run_id string, project string, created_at timestamp")
    assert {r["run_id"] for r in O.prune_plan(runs, keep=2).collect()} == {"0", "1"}
    with pytest.raises(ValueError):
        O.prune_plan(runs)


def test_upper_medians_without_gathering(spark):
    rows = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)] + [("h", 5)], "g string, v int")
    assert {r["g"]: r["median"] for r in FL.upper_medians(rows, ["g"], "v").collect()} == {"g": 3, "h": 5}
    assert rows.groupBy("g").agg(FL.upper_median("v").alias("m")).where("g = 'g'").first()["m"] == 3
