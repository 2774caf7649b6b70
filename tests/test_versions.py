import itertools

import pytest
from packaging.specifiers import SpecifierSet
from packaging.version import Version
from pyspark.sql import functions as F

from plumbline.functions import versions as V

NPM = [
    ("^1.2.3", "1.2.3", True), ("^1.2.3", "1.99.0", True), ("^1.2.3", "1.2.2", False), ("^1.2.3", "2.0.0-alpha", False), ("^1", "1.0.0", True), ("^0", "0.9.9", True), ("^0", "1.0.0", False),
    ("^0.1", "0.1.9", True), ("^0.1", "0.2.0", False), ("^0.0", "0.0.7", True), ("^0.0.1", "0.0.2", False), ("~1.2", "1.2.0", True), ("~1.2", "1.3.0", False), ("~1", "1.9.0", True), ("~>1.2.1", "1.2.9", True),
    ("1.x", "1.4.0", True), ("1.2.x", "1.3.0", False), ("x", "3.0.0", True), (">=1.2.3 <2", "1.9.9", True), (">=1.2.3 <2", "2.0.0", False), (">1", "2.0.0", True), (">1", "1.9.0", False), ("<1", "0.9.9", True),
    ("<1", "1.0.0-pre", False), ("<=1", "1.9.9", True), ("1.0.0 - 2.0.0", "2.0.0", True), ("1.0.0 - 2", "2.9.9", True), ("1.0.0 - 2", "3.0.0", False), ("=1.2.3", "1.2.3+build", True), ("v1.2.3", "1.2.3", True),
    ("> 1.0.0", "1.0.1", True), ("1.2.3-alpha || 2.x", "1.2.3-alpha", True), ("^1.2.3-rc.1", "1.2.3-rc.2", True), ("^1.2.3-rc.1", "1.3.0-rc.2", False), ("<*", "0.0.1", False), ("", "1.2.3", True), ("latest", "1.0.0", None),
]
PEP = ["1.0", "1.0a1", "1.0a2.dev1", "1.0.dev1", "1.0.post1", "1.0.post1.dev2", "1.0.1", "1.1", "1.1a1", "2.0", "1!1.0", "0.9", "1.0rc1", "1.0b3", "1.0.0"]


def _satisfied(spark, ecosystem, pairs):
    rows = spark.createDataFrame([(ecosystem, s, v) for s, v in pairs], "ecosystem string, spec string, version string")
    rows = V.with_compiled(rows).withColumn("parsed", V.version_columns(F.col("ecosystem"), F.col("version")))
    return {(r["spec"], r["version"]): r["ok"] for r in rows.select("spec", "version", V.satisfies(F.col("parsed"), F.col("compiled")).alias("ok")).collect()}


def test_npm_ranges(spark):
    got = _satisfied(spark, "npm", [(s, v) for s, v, _ in NPM])
    assert {(s, v): ok for s, v, ok in NPM} == got


def test_pep440_specifiers_agree_with_packaging(spark):
    specs = [op + v for op in ("<", ">", "<=", ">=", "==", "!=", "~=") for v in ("1.0", "1.0a1", "1.0.post1", "1.1", "1.0.dev1", "1!1.0", "1.0.1")] + ["==1.*", "==1.0.*", "!=1.0.*", ">=1.0,<2", ""]
    got = _satisfied(spark, "pypi", list(itertools.product(specs, PEP)))
    assert got == {(s, v): SpecifierSet(s).contains(Version(v), prereleases=True) for s, v in got}


def test_keys_order_like_the_schemes(spark):
    rows = spark.createDataFrame([(v,) for v in PEP], "v string").select("v", V.pep440_columns(F.col("v"))["key"].alias("key")).collect()
    assert {r["v"]: r["key"] for r in rows} == {v: V.parse_pep440(v).key for v in PEP}
    for a, b in itertools.product(PEP, PEP):
        x, y = V.parse_pep440(a).key, V.parse_pep440(b).key
        assert (x < y, x == y) == (Version(a) < Version(b), Version(a) == Version(b)), (a, b)
    ordered = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0", "1.0.9", "1.0.10", "2.0.0-rc.1", "10.0.0"]
    rows = spark.createDataFrame([(v,) for v in ordered], "v string").select("v", V.semver_columns(F.col("v"), "npm")["key"].alias("key")).collect()
    keys = {r["v"]: r["key"] for r in rows}
    assert sorted(ordered, key=keys.get) == ordered and keys == {v: V.parse_semver("npm", v).key for v in ordered}


@pytest.mark.parametrize(
    "ecosystem, spec, exact",
    [("npm", "1.2.3", True), ("npm", "^1.2.3", False), ("npm", "1.2", False), ("pypi", "==1.0", True), ("pypi", "==1.*", False), ("pypi", "===1.0", True), ("cargo", "=1.2.3", True), ("cargo", "1.2.3", False), ("golang", "v1.2.3", True), ("golang", ">=v1.2.3", False), ("terraform", "1.5.7", True), ("terraform", "~> 1.5", False)],
)
def test_exactness(ecosystem, spec, exact):
    assert V.compile_spec(ecosystem, spec)["exact"] is exact


def test_release_bounds():
    r = V.Release.parse
    assert [r(x).caret_upper() for x in ("1.2.3", "0.2.3", "0.0.3", "0", "0.0", "0.0.0")] == [(2, 0, 0), (0, 3, 0), (0, 0, 4), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert [r(x).tilde_upper() for x in ("1", "1.2", "1.2.3")] == [(2, 0, 0), (1, 3, 0), (1, 3, 0)]
    assert [r(x).pessimistic_upper() for x in ("1", "1.2", "1.2.3")] == [(2, 0, 0), (2, 0, 0), (1, 3, 0)]


def test_poetry_refuses_alternations():
    assert V.poetry_to_pep440("^1.2 || ^2.0") is None and V.poetry_to_pep440("^1.2.3") == ">=1.2.3,<2.0.0" and V.poetry_to_pep440("*") == ""


def test_corpora_are_whole(spark):
    from plumbline import catalog
    from plumbline.plans import catalog_packages as P

    assert [len(x) for x in (P.NPM_CORPUS, P.PEP440_CORPUS, P.COMPARED["npm_comparisons"][1], P.COMPARED["pep440_comparisons"][1])] == [94 + 77, 391, 17, 253]
    for name, cases in (("npm_conformance_whole", P.NPM_CORPUS), ("pep440_conformance_whole", P.PEP440_CORPUS), ("npm_comparisons", P.COMPARED["npm_comparisons"][1]), ("pep440_comparisons", P.COMPARED["pep440_comparisons"][1])):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, "").collect()]
        assert [x for x in got if list(x) not in [list(c) for c in cases]] == [] and len(got) == len(cases), name
