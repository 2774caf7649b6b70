"""Table functions over inline files, against golden rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import scalars as S
from plumbline.operators import findings as FI
from plumbline.operators import graph as G
from plumbline.operators import observations as O
from plumbline.operators import rollup as R
from plumbline.plans.base import query, table
from plumbline.sources import emit, extractors, files, lockfiles, registries, toolbox

SHA = "b" * 40


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


# what each extractor reads, and (target, spec, scope) it must give
EXTRACTED: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "extract_npm_manifest": (
        "package.json",
        json.dumps({"dependencies": {"a": "^1", "w": "workspace:*"}, "devDependencies": {"@t/x": "npm:real@^2"}, "peerDependencies": {"@s/p": ">=1"}}),
        [("pkg:npm/a", "^1", "prod"), ("pkg:npm/w", "", "prod"), ("pkg:npm/real", "^2", "dev"), ("pkg:npm/%40s/p", ">=1", "peer")],
    ),
    "extract_pyproject": (
        "pyproject.toml",
        '[project]\ndependencies = ["Requests[socks] >=2,<3", "flask"]\noptional-dependencies = {x = ["a.b==1"]}\n[dependency-groups]\ndev = ["pytest", {include-group = "lint"}]\nlint = ["ruff>=0.1"]\n',
        [("pkg:pypi/requests", ">=2,<3", "prod"), ("pkg:pypi/flask", "", "prod"), ("pkg:pypi/a-b", "==1", "optional"), ("pkg:pypi/pytest", "", "dev"), ("pkg:pypi/ruff", ">=0.1", "dev"), ("pkg:pypi/ruff", ">=0.1", "dev")],
    ),
    "extract_poetry": (
        "pyproject.toml",
        '[tool.poetry.dependencies]\npython = "^3.9"\ndjango = "^4.2"\nlocal = {path = "../x"}\nalt = "^1 || ^2"\nopt = {version = "1.0", optional = true}\n[tool.poetry.group.dev.dependencies]\nmypy = "*"\n',
        [("pkg:pypi/django", ">=4.2,<5.0.0", "prod"), ("pkg:pypi/alt", "", "prod"), ("pkg:pypi/opt", "==1.0", "optional"), ("pkg:pypi/mypy", "", "dev")],
    ),
    "extract_requirements": ("requirements.txt", "flask==2.0  # web\nA_b >= 1, < 2\n# no\n-r other.txt\n", [("pkg:pypi/flask", "==2.0", "prod"), ("pkg:pypi/a-b", ">=1,<2", "prod")]),
    "extract_cargo": (
        "Cargo.toml",
        '[dependencies]\na = "1"\nren = {version = "2", package = "real"}\np = {path = "x"}\n[dev-dependencies]\nd = "3"\n[target."cfg(unix)".dependencies]\nu = {version = "4", optional = true}\n',
        [("pkg:cargo/a", "1", "prod"), ("pkg:cargo/real", "2", "prod"), ("pkg:cargo/d", "3", "dev"), ("pkg:cargo/u", "4", "optional")],
    ),
    "extract_gomod": (
        "go.mod",
        "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/i/i v1.0.0 // indirect\n)\nrequire github.com/l/l v1.0.0\nreplace github.com/l/l => ../l\nreplace github.com/a/b => github.com/f/b v1.3.0\n",
        [("pkg:golang/github.com/f/b@v1.3.0", "v1.3.0", "prod"), ("pkg:golang/github.com/l/l", "", "prod")],
    ),
    "extract_terraform": (
        "main.tf",
        'terraform {\n  required_version = ">= 1.5"\n  required_providers {\n    aws = {\n      source = "hashicorp/aws"\n      version = "~> 5.0"\n    }\n  }\n}\nmodule "m" {\n  source = "a/b/c"\n  version = "1.0"\n}\nmodule "l" {\n  source = "./x"\n}\n',
        [("pkg:terraform-cli/hashicorp/terraform", ">= 1.5", "prod"), ("pkg:terraform/hashicorp/aws", "~> 5.0", "prod"), ("pkg:terraform-module/a/b-c@1.0", "1.0", "prod")],
    ),
    "extract_terraform_pin": (".tool-versions", "nodejs 20\nterraform 1.5.7\n", [("pkg:terraform-cli/hashicorp/terraform@1.5.7", "1.5.7", "prod")]),
}

# build files: (target, edge kind, completeness, reason); their own node is left out
BUILT: dict[str, tuple[str, str, list[tuple[str, str, str, str | None]]]] = {
    "extract_dockerfile": (
        "Dockerfile",
        "ARG V=3.19\nFROM --platform=$P alpine:$V AS base\nRUN apk add --virtual .x curl=8.1 \\\n  git\nFROM base\nFROM scratch\n",
        [("pkg:oci/alpine@3.19", "builds_on", "declared", "unpinned-ref"), ("pkg:apk/alpine/curl@8.1", "installs", "inferred", "inferred:run"), ("pkg:apk/alpine/git", "installs", "inferred", "inferred:run")],
    ),
    "extract_workflow": (
        ".github/workflows/ci.yml",
        f"jobs:\n  a:\n    container: {{image: 'node:20'}}\n    steps:\n    - uses: actions/checkout@v4\n    - uses: o/r/sub@{SHA}\n    - uses: ./local\n    - uses: docker://alpine:3\n",
        [("pkg:oci/node@20", "builds_on", "declared", "unpinned-ref"), ("pkg:github/actions/checkout@v4", "invokes", "declared", "unpinned-ref"), (f"pkg:github/o/r@{SHA}#sub", "invokes", "resolved", None), ("pkg:oci/alpine@3", "builds_on", "declared", "unpinned-ref")],
    ),
    "extract_gitlab_ci": (
        ".gitlab-ci.yml",
        "include:\n- project: g/p\n  ref: v1\n  file: /t.yml\n- component: gitlab.com/c/d@1.0\n- local: /.gitlab/x.yml\njob:\n  image: {name: 'ruby:3'}\n  services: ['pg:15']\n",
        [("pkg:gitlab/g/p@v1#t.yml", "invokes", "resolved", None), ("pkg:gitlab/c/d@1.0", "invokes", "resolved", None), ("pkg:oci/ruby@3", "builds_on", "declared", "unpinned-ref"), ("pkg:oci/pg@15", "builds_on", "declared", "unpinned-ref")],
    ),
    "extract_pre_commit": (
        ".pre-commit-config.yaml",
        "repos:\n- repo: https://github.com/o/h.git\n  rev: v1\n  hooks:\n  - id: x\n    additional_dependencies: ['types-x==1']\n- repo: local\n  hooks: []\n",
        [("pkg:github/o/h@v1", "invokes", "declared", "unpinned-ref"), ("pkg:pypi/types-x", "depends_on", None, None)],
    ),
}

LOCKED: dict[str, tuple[str, str, list[str]]] = {
    "lock_npm": ("package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}, "node_modules/l": {"link": true}}}', ["pkg:npm/a@1", "pkg:npm/%40s/b@2"]),
    "lock_pnpm": ("pnpm-lock.yaml", "packages:\n  /a/1.0.0: {}\n  '@s/b@2.0.0(peer@1)': {}\n", ["pkg:npm/a@1.0.0", "pkg:npm/%40s/b@2.0.0"]),
    "lock_yarn": ("yarn.lock", '# yarn\n"@s/b@^1", b@^2:\n  version "1.5.0"\na@^1:\n  version "1.0.0"\n', ["pkg:npm/%40s/b@1.5.0", "pkg:npm/a@1.0.0"]),
    "lock_yarn_berry": ("yarn.lock", '__metadata:\n  version: 8\n"a@npm:^1":\n  version: 1.2.0\n  resolution: "a@npm:1.2.0"\n"w@workspace:.":\n  version: 0.0.0\n  resolution: "w@workspace:."\n', ["pkg:npm/a@1.2.0"]),
    "lock_bun": ("bun.lock", '{ // c\n"packages": {"a": ["a@1.0.0", "http://x//y", {},], "w": ["w@workspace:w"],},\n}', ["pkg:npm/a@1.0.0"]),
    "lock_cargo": ("Cargo.lock", '[[package]]\nname="a"\nversion="1"\nsource="r"\n[[package]]\nname="me"\nversion="0"\n[[package]]\nname="a"\nversion="2"\nsource="r"\n', ["pkg:cargo/a@1", "pkg:cargo/a@2"]),
    "lock_gomod": ("go.mod", "require a.b/c v1.0.0 // indirect\nrequire d.e/f v2.0.0\n", ["pkg:golang/a.b/c@v1.0.0", "pkg:golang/d.e/f@v2.0.0"]),
    "lock_poetry": ("poetry.lock", '[[package]]\nname="A_b"\nversion="1"\n', ["pkg:pypi/a-b@1"]),
    "lock_uv": ("uv.lock", '[[package]]\nname="a"\nversion="1"\n[[package]]\nname="me"\nversion="0"\nsource={virtual="."}\n', ["pkg:pypi/a@1"]),
    "lock_terraform": (".terraform.lock.hcl", 'provider "registry.terraform.io/hashicorp/aws" {\n  version = "5.1.0"\n}\n', ["pkg:terraform/hashicorp/aws@5.1.0"]),
}


def _extractor(name, path, text, want):
    @query(_values(want, "to_id, spec, scope"), name=name)
    def run(spark, sf):
        rows = extractors.extract(files.static(spark, {path: text}))
        return rows.where(F.col("extractor") == name.removeprefix("extract_").replace("npm_manifest", "npm-manifest").replace("terraform_pin", "terraform-version")).select("to_id", "spec", "scope")


def _built(name, path, text, want):
    @query(_values(want, "to_id, kind, completeness, reason"), name=name)
    def run(spark, sf):
        rows = extractors.extract(files.static(spark, {path: text}))
        return rows.where("to_id NOT LIKE '%buildfile%' AND to_id NOT LIKE '%opaque%'").select("to_id", "kind", "completeness", "reason")


def _locked(name, path, text, want):
    @query(_values([(w,) for w in want], "node_id"), name=name)
    def run(spark, sf):
        return lockfiles.read(files.static(spark, {path: text})).select("node_id")


for _cases, _make in ((EXTRACTED, _extractor), (BUILT, _built), (LOCKED, _locked)):
    for _name, _case in _cases.items():
        _make(_name, *_case)


@query(_values([(".husky/pre-commit", "husky", "hook"), ("a/tox.ini", "tox", "orchestrator"), (".circleci/config.yml", "ci", "orchestrator"), ("renovate.json", "renovate", "bot")], "path, tool, category"))
def coverage_catalogue(spark, sf):
    rows = extractors.extract(files.static(spark, dict.fromkeys((".husky/pre-commit", "a/tox.ini", ".circleci/config.yml", "renovate.json", "src/main.c", "vendor/go.sum"), "")))
    return rows.where("extractor = 'coverage'").select("path", F.col("name").alias("tool"), F.regexp_extract("to_id", "category=(.*)$", 1).alias("category"))


@query("SELECT CAST(87 AS BIGINT) AS pairs")
def tools_listing(spark, sf):
    return toolbox.catalogue(spark).agg(F.count(F.lit(1)).alias("pairs"))


@query(_values([("package.json", "npm-manifest"), ("pyproject.toml", "pyproject,poetry"), ("x/Dockerfile.dev", "dockerfile"), ("node_modules/a/package.json", ""), (".github/workflows/a.yaml", "workflow"), ("main.tf", "terraform")], "path, names"))
def path_claims(spark, sf):
    paths = [("package.json",), ("pyproject.toml",), ("x/Dockerfile.dev",), ("node_modules/a/package.json",), (".github/workflows/a.yaml",), ("main.tf",)]
    return spark.createDataFrame(paths, "path string").select("path", F.array_join(extractors.claims(F.col("path")), ",").alias("names"))


@query(_values([("error:parse", "package.json"), ("error:parse", ".github/workflows/x.yml")], "reason, source"))
def parse_errors(spark, sf):
    rows = extractors.extract(files.static(spark, {"package.json": "{", ".github/workflows/x.yml": "a: [", "go.mod": "module x\n"}))
    return rows.where("reason = 'error:parse'").select("reason", "source")


@query(_values([("a", "1.0.0", "x", "^1", "prod"), ("a", "1.0.0", "z", "2", "dev")], "name, version, dep_name, spec, scope"))
def registry_npm(spark, sf):
    body = json.dumps({"name": "a", "versions": {"1.0.0": {"dependencies": {"x": "^1"}, "devDependencies": {"y": "npm:z@2"}}, "2.0.0": {}}})
    return registries.npm(spark.createDataFrame([(body,)], "body string"))[1].drop("ecosystem")


@query(_values([("p-q", "1", "2020-01-01")], "name, version, day"))
def registry_pypi(spark, sf):
    files_ = {"1": [{"upload_time_iso_8601": "2020-01-02T00:00:00Z", "yanked": False}, {"upload_time_iso_8601": "2020-01-01T00:00:00Z", "yanked": False}], "2": [{"upload_time_iso_8601": "2021-01-01T00:00:00Z", "yanked": True}], "3": []}
    body = json.dumps({"info": {"name": "P.q", "requires_dist": []}, "releases": files_})
    rows = registries.pypi(spark.createDataFrame([(body, None)], "body string, version string"))[0]
    return rows.select("name", "version", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query(_values([("k", "1.0.0", "real", "^1")], "name, version, dep_name, spec"))
def registry_crates(spark, sf):
    lines = [{"name": "k", "vers": "1.0.0", "yanked": False, "deps": [{"name": "r", "req": "^1", "kind": "normal", "optional": False, "package": "real"}, {"name": "t", "req": "1", "kind": "dev", "optional": False}]}, {"name": "k", "vers": "2.0.0", "yanked": True, "deps": [{"name": "r", "req": "^1", "kind": "normal", "optional": False}]}]
    return registries.crates(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))[1].select("name", "version", "dep_name", "spec")


@query(_values([("a.b/c", "v1.0.0")], "dep_name, spec"))
def registry_go(spark, sf):
    mods = spark.createDataFrame([("m", "v1", "module m\nrequire (\n a.b/c v1.0.0\n d.e/f v2.0.0 // indirect\n)\nreplace a.b/c => ../c\n")], "module string, version string, value string")
    return registries.go_requirements(mods).select("dep_name", "spec")


@query(_values([("r1", "SLSA_ATTESTATION", "true"), ("", "", "false")], "source_repo, provenance, attested"))
def version_facts(spark, sf):
    link = lambda i, how: {"projectKey": {"id": i}, "relationType": "SOURCE_REPO", "relationProvenance": how}
    bodies = [json.dumps({"relatedProjects": [link("r0", "UNVERIFIED"), link("r1", "SLSA_ATTESTATION")], "attestations": [{"verified": True}]}), "{}"]
    rows = spark.createDataFrame([(str(i), True, b) for i, b in enumerate(bodies)], "node_id string, queried boolean, body string")
    return registries.version_facts(rows).select("source_repo", "provenance", F.col("attested").cast("string").alias("attested"))


@query("SELECT DISTINCT 'pkg:npm/' || CASE WHEN l_quantity >= 49 THEN 'a' ELSE 'root' END || l_orderkey % 5 AS from_id, 'pkg:npm/b' || l_partkey % 7 AS to_id FROM lineitem")
def merge_placements_whole(spark, sf):
    return _merged_placements(table(spark, sf, "lineitem"))


def _merged_placements(rows):
    """Instances hang on their parent instance's node, else on the root."""
    rows = rows.withColumn("g", F.col("l_orderkey") % 5)
    tops = rows.select(F.concat(F.lit("top"), "g").alias("locator"), F.concat(F.lit("pkg:npm/a"), "g").alias("node_id"), F.lit(None).cast("string").alias("parent_locator"), F.col("g").alias("run_id")).distinct()
    kids = rows.select(F.concat_ws("/", F.lit("k"), "l_orderkey", "l_linenumber", "l_partkey").alias("locator"), F.concat(F.lit("pkg:npm/b"), F.col("l_partkey") % 7).alias("node_id"), F.when(F.col("l_quantity") >= 49, F.concat(F.lit("top"), "g")).alias("parent_locator"), F.col("g").alias("run_id"))
    roots = tops.select("run_id", F.concat(F.lit("pkg:npm/root"), "run_id").alias("id")).distinct()
    return R.merge_instances(tops.unionByName(kids), roots)[1].where("to_id LIKE '%/b%'").select("from_id", "to_id").distinct()


@query("""
WITH s AS (SELECT 'pkg:generic/buildfile/workflow@x#' || l_orderkey AS f, l_partkey AS t, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2)
SELECT substr(f, 34) AS file, CAST(row_number() OVER (PARTITION BY f ORDER BY o, t) AS INTEGER) AS step, t AS to_id FROM s""")
def formulation_steps_whole(spark, sf):
    return _formulation(table(spark, sf, "lineitem"))


def _formulation(rows):
    e = rows.select(F.concat(F.lit("pkg:generic/buildfile/workflow@x#"), "l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("installs").alias("kind"), F.col("l_linenumber").alias("ord"))
    return emit.formulation(e, e.select(F.col("to_id").alias("id"), F.lit("").alias("note")).distinct()).select("file", "step", "to_id")


@query("""
WITH h AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS n, CASE WHEN p_size >= 48 THEN 4 ELSE 3 END AS r FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 44 AND l_quantity >= 45),
t AS (SELECT f, sum(r) AS weight, count(*) AS hits FROM h GROUP BY f ORDER BY weight DESC, CAST(f AS VARCHAR) LIMIT 12)
SELECT CAST(f AS VARCHAR) AS file, CAST(weight AS BIGINT) AS weight, CAST(hits AS BIGINT) AS hits, n AS node, CAST(place AS INTEGER) AS place FROM (
  SELECT t.f, weight, hits, n, row_number() OVER (PARTITION BY t.f ORDER BY r DESC, n) AS place FROM h JOIN t ON h.f = t.f) WHERE place <= 6""")
def risk_map(spark, sf):
    part = table(spark, sf, "part").where("p_size >= 44").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") >= 48, "CRITICAL").otherwise("HIGH").alias("label"))
    named = table(spark, sf, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_suppkey").cast("string").alias("file")).agg(F.collect_set("l_partkey").alias("names"))
    return emit.risk_map_rows(named, part).select("file", "weight", "hits", "node", "place")


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'application' WHEN 2 THEN 'file' ELSE 'library' END AS type,
  CASE WHEN c_custkey % 3 = 0 THEN 'id' WHEN c_custkey % 3 = 1 THEN 'expression' END AS slot FROM customer""")
def cyclonedx_components(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    id_ = F.concat(F.when(k % 4 == 0, "pkg:oci/i").when(k % 4 == 1, "pkg:github/o/r").when(k % 4 == 2, "pkg:generic/buildfile/workflow@1#f").otherwise("pkg:npm/p"), k)
    licence = F.when(k % 3 == 0, F.array(F.lit("MIT"))).when(k % 3 == 1, F.array(F.lit("MIT OR ISC"))).otherwise(F.array(F.lit("non-standard")))
    nodes = c.select(id_.alias("id"), F.lit("n").alias("name"), F.lit("1").alias("version"), F.lit("resolved").alias("completeness"), F.lit(None).cast("string").alias("reason"))
    rows = emit.components(nodes, c.select(id_.alias("node_id"), licence.alias("licenses")))
    return rows.select(F.regexp_extract("bom_ref", r"(\d+)$", 1).cast("long").alias("id"), "type", F.get("licenses", 0)["slot"].alias("slot"))


@query("""
WITH u AS (SELECT user_id, ts, event_id, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM u)
SELECT user_id, event_type AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM r WHERE rn = 1""")
def first_seen_order(spark, sf):
    e = table(spark, sf, "events")
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).where("rn = 1")
    return first.select("user_id", F.col("event_type").alias("source"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


@query("SELECT e AS message, k AS kind FROM (VALUES ('HTTP 404', '404'), ('Not Found', '404'), ('429 Too Many Requests', 'ratelimit'), ('crates.io exploded', 'fetch'), ('timeout', 'fetch')) t(e, k)")
def error_kinds(spark, sf):
    rows = spark.createDataFrame([("HTTP 404",), ("Not Found",), ("429 Too Many Requests",), ("crates.io exploded",), ("timeout",)], "message string")
    return rows.select("message", S.error_kind(F.col("message")).alias("kind"))


@query("""
SELECT 'pkg:github/o/a' || o_custkey % 50 || '@v' || o_orderkey % 3 AS node_id, 'o/a' || o_custkey % 50 AS action, 'v' || o_orderkey % 3 AS ref, 'A' || o_orderkey AS osv_id FROM orders WHERE o_orderpriority = '1-URGENT'""")
def action_advisories(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    node = F.concat(F.lit("pkg:github/o/a"), F.col("o_custkey") % 50, F.lit("@v"), F.col("o_orderkey") % 3)
    rows = o.select(node.alias("node_id"), F.concat(F.lit("A"), "o_orderkey").alias("osv_id"), F.lit("HIGH").alias("label"))
    return FI.action_findings(rows).drop("label", "claim")


@query("SELECT DISTINCT l_orderkey % 20 AS from_n, l_partkey % 20 AS to_n FROM lineitem WHERE l_orderkey % 20 % 2 = 0 AND l_partkey % 20 % 2 = 0")
def package_edge_projection(spark, sf):
    name = lambda c: F.concat(F.when(F.col(c) % 20 % 2 == 0, "pkg:npm/p").otherwise("pkg:oci/i"), F.col(c) % 20)
    e = table(spark, sf, "lineitem").select(name("l_orderkey").alias("from_id"), name("l_partkey").alias("to_id"))
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return G.package_edges(e).select(number("from_id").alias("from_n"), number("to_id").alias("to_n"))


@query("""
SELECT 'nat' || n_nationkey AS key, CAST(CASE WHEN n_nationkey < 10 THEN n_nationkey + 1 ELSE n_nationkey + 1 END AS INTEGER) AS num, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'old' END AS name FROM nation WHERE n_nationkey < 10 OR n_nationkey % 2 = 0 AND false
UNION ALL SELECT 'nat' || n_nationkey, CAST(10 + row_number() OVER (ORDER BY 'nat' || n_nationkey) AS INTEGER), n_name FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 2 = 0""")
def project_upsert(spark, sf):
    n = table(spark, sf, "nation")
    at = F.to_timestamp(F.lit("2024-01-01"))
    key = F.concat(F.lit("nat"), "n_nationkey").alias("key")
    old = n.where("n_nationkey < 10").select(key, (F.col("n_nationkey") + 1).cast("int").alias("num"), F.lit("old").alias("name"), at.alias("created_at"))
    new = n.where("n_nationkey % 2 = 0").select(key, F.col("n_name").alias("name"), at.alias("created_at"))
    return O.upsert_projects(old, new).select("key", "num", "name")
