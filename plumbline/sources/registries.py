"""Registry documents to version and requirement tables, natively parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.purl import go_escape, pypi_name

NPM = (
    "name string, time map<string,string>, versions map<string, struct<dependencies: map<string,string>, devDependencies: map<string,string>, "
    "peerDependencies: map<string,string>, optionalDependencies: map<string,string>>>"
)
PYPI = "info struct<name: string, requires_dist: array<string>>, releases map<string, array<struct<upload_time_iso_8601: string, yanked: boolean>>>"
CRATE = "name string, vers string, yanked boolean, pubtime string, deps array<struct<name: string, req: string, kind: string, optional: boolean, package: string>>"


def _requirement(ecosystem: str, name: Column, version: Column, dep: Column, spec: Column, scope: Column) -> list[Column]:
    return [F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), dep.alias("dep_name"), spec.alias("spec"), scope.alias("scope")]


def npm(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions and requirements of packuments in ``body``. Only full ones have
    publish times. Aliases lead to the package they name."""
    doc = documents.select(F.from_json("body", NPM).alias("d")).select("d.name", "d.time", F.explode("d.versions").alias("version", "v"))
    versions = doc.select(F.lit("npm").alias("ecosystem"), "name", "version", F.try_to_timestamp(F.get(F.array(F.col("time")[F.col("version")]), 0)).alias("published_at"))
    scopes = (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))
    out = None
    for field, scope in scopes:
        part = doc.select("name", "version", F.explode(F.col(f"v.{field}")).alias("dep", "spec"))
        alias = r"^npm:(.+?)(?:@([^@]*))?$"
        real = F.when(F.col("spec").rlike("^npm:"), F.regexp_extract("spec", alias, 1)).otherwise(F.col("dep"))
        spec = F.when(F.col("spec").rlike("^npm:"), F.coalesce(F.nullif(F.regexp_extract("spec", alias, 2), F.lit("")), F.lit("*"))).otherwise(F.col("spec"))
        part = part.select(*_requirement("npm", F.col("name"), F.col("version"), real, spec, F.lit(scope)))
        out = part if out is None else out.unionByName(part)
    return versions, out


def pypi(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Releases with a file that is not yanked, published when the first such was
    uploaded; requirements of ``body`` belong to ``version`` of the document."""
    doc = documents.select("version", F.from_json("body", PYPI).alias("d"))
    rel = doc.select(pypi_name(F.col("d.info.name")).alias("name"), F.explode("d.releases").alias("version", "files"))
    good = F.filter("files", lambda f: ~F.coalesce(f["yanked"], F.lit(False)))
    versions = rel.where(F.size(good) > 0).select(
        F.lit("pypi").alias("ecosystem"), "name", "version", F.array_min(F.transform(good, lambda f: F.try_to_timestamp(f["upload_time_iso_8601"]))).alias("published_at")
    )
    need = doc.where("version IS NOT NULL").select(pypi_name(F.col("d.info.name")).alias("name"), "version", F.explode("d.info.requires_dist").alias("r"))
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;()]*)\)?\s*(?:;(.*))?$"
    part = lambda n: F.regexp_extract("r", pattern, n)
    scope = F.when(part(3).rlike(r"\bextra\s*=="), "optional").otherwise("prod")
    requirements = need.where(F.col("r").rlike(pattern)).select(*_requirement("pypi", F.col("name"), F.col("version"), pypi_name(part(1)), F.regexp_replace(part(2), r"\s+", ""), scope))
    return versions, requirements


def crates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of a sparse index: yanked versions and dev dependencies are left
    out, renames lead to the crate they name."""
    doc = lines.select(F.from_json("value", CRATE).alias("d")).select("d.*").where("vers IS NOT NULL AND NOT coalesce(yanked, false)")
    versions = doc.select(F.lit("cargo").alias("ecosystem"), "name", F.col("vers").alias("version"), F.try_to_timestamp("pubtime").alias("published_at"))
    need = doc.select("name", "vers", F.explode("deps").alias("p")).where("coalesce(p.kind, 'normal') <> 'dev'")
    scope = F.when(F.col("p.optional"), "optional").otherwise("prod")
    return versions, need.select(*_requirement("cargo", F.col("name"), F.col("vers"), F.coalesce("p.package", "p.name"), F.col("p.req"), scope))


def crate_path(name: Column) -> Column:
    """Where the sparse index keeps a crate, by the length of its name."""
    low, n = F.lower(name), F.length(name)
    cut = lambda a, b: F.substring(low, a, b)
    return (
        F.when(n == 1, F.concat(F.lit("1/"), low))
        .when(n == 2, F.concat(F.lit("2/"), low))
        .when(n == 3, F.concat(F.lit("3/"), cut(1, 1), F.lit("/"), low))
        .otherwise(F.concat_ws("/", cut(1, 2), cut(3, 2), low))
    )


def go_versions(lists: DataFrame) -> DataFrame:
    """``module, value`` of ``@v/list`` documents to versions."""
    rows = lists.select("module", F.explode(F.split("value", r"\s+")).alias("version")).where("version <> ''")
    return rows.select(F.lit("golang").alias("ecosystem"), F.col("module").alias("name"), "version", F.lit(None).cast("timestamp").alias("published_at"))


def go_requirements(mods: DataFrame) -> DataFrame:
    """Direct requires of ``module, version, value`` go.mod documents."""
    body = F.regexp_replace("value", r"(?s)\bexclude\s*\([^)]*\)|\breplace\s*\([^)]*\)|\bretract\s*\([^)]*\)", "")
    line = F.explode(F.split(body, "\n")).alias("l")
    rows = mods.select("module", "version", line).where(~F.col("l").contains("// indirect"))
    pattern = r"^\s*(?:require\s+)?([^\s()\"]+\.[^\s()\"]+)\s+(v[^\s]+)\s*(?://.*)?$"
    rows = rows.where(F.col("l").rlike(pattern) & ~F.col("l").rlike(r"^\s*(replace|exclude|retract|module)\b|=>"))
    return rows.select(*_requirement("golang", F.col("module"), F.col("version"), F.regexp_extract("l", pattern, 1), F.regexp_extract("l", pattern, 2), F.lit("prod")))


def go_proxy_path(module: Column, version: Column) -> Column:
    return F.concat(go_escape(module), F.lit("/@v/"), version, F.lit(".mod"))


def repositories(pages: DataFrame, forks: bool = False, archived: bool = False) -> DataFrame:
    """Repositories of an organisation listing, forks and archived left out."""
    rows = pages
    if not forks:
        rows = rows.where("NOT fork")
    if not archived:
        rows = rows.where("NOT archived")
    return rows.dropDuplicates(["full_name"]).orderBy(F.desc("stars"), "full_name")


def version_facts(documents: DataFrame) -> DataFrame:
    """Facts per version from package documents, index-aligned: one row for each
    input. A link that an attestation proves wins over one that metadata claims."""
    schema = (
        "isDeprecated boolean, deprecatedReason string, licenses array<string>, advisoryKeys array<struct<id: string>>, attestations array<struct<verified: boolean>>, "
        "relatedProjects array<struct<projectKey: struct<id: string>, relationType: string, relationProvenance: string>>"
    )
    d = documents.select("node_id", "queried", F.from_json("body", schema).alias("d"))
    repos = F.filter("d.relatedProjects", lambda p: p["relationType"] == "SOURCE_REPO")
    proven = F.filter(repos, lambda p: p["relationProvenance"] == "SLSA_ATTESTATION")
    best = F.coalesce(F.get(proven, 0), F.get(repos, 0))
    return d.select(
        "node_id", "queried", F.col("d").isNotNull().alias("known"), F.coalesce("d.isDeprecated", F.lit(False)).alias("deprecated"), F.coalesce("d.deprecatedReason", F.lit("")).alias("deprecated_reason"),
        F.coalesce("d.licenses", F.array().cast("array<string>")).alias("licenses"), F.transform("d.advisoryKeys", lambda a: a["id"]).alias("advisory_ids"),
        F.coalesce(F.exists("d.attestations", lambda a: a["verified"]), F.lit(False)).alias("attested"), F.coalesce(best["projectKey"]["id"], F.lit("")).alias("source_repo"), F.coalesce(best["relationProvenance"], F.lit("")).alias("provenance"),
    )


def scorecards(documents: DataFrame) -> DataFrame:
    """Projects with their checks as a map; details keep warnings and errors only."""
    schema = "starsCount int, scorecard struct<overallScore: double, checks: array<struct<name: string, score: int, reason: string, details: array<string>>>>"
    d = documents.select("project_id", F.from_json("body", schema).alias("d"))
    checks = F.map_from_entries(
        F.transform(
            "d.scorecard.checks",
            lambda c: F.struct(c["name"], F.struct(c["score"].alias("score"), c["reason"].alias("reason"), F.filter(c["details"], lambda x: x.rlike("^(Warn|Error):")).alias("warnings"))),
        )
    )
    return d.select("project_id", F.col("d.starsCount").alias("stars"), F.col("d.scorecard").isNotNull().alias("has_scorecard"), F.col("d.scorecard.overallScore").alias("overall_score"), checks.alias("checks"))


def osv(documents: DataFrame) -> DataFrame:
    """Advisory records of OSV documents in ``body``."""
    schema = "id string, summary string, published string, withdrawn string, aliases array<string>, severity array<struct<type: string, score: string>>, database_specific struct<severity: string>"
    d = documents.select(F.from_json("body", schema).alias("d"))
    return d.select(
        F.col("d.id").alias("osv_id"), F.coalesce("d.summary", F.lit("")).alias("summary"), F.coalesce("d.database_specific.severity", F.lit("")).alias("severity"), F.get("d.severity", 0)["score"].alias("cvss"),
        F.try_to_timestamp("d.published").alias("published"), F.try_to_timestamp("d.withdrawn").alias("withdrawn"), F.coalesce("d.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def blobs(documents: DataFrame, column: str = "content") -> DataFrame:
    """Content-addressed rows: the hash, and the shard it is written under."""
    key = F.sha2(F.col(column), 256)
    return documents.withColumn("sha256", key).withColumn("shard", F.substring("sha256", 1, 2))
