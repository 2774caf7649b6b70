"""Security controls in a repository's build: actions, bots and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.findings import run_keys

#: Kinds of controls, in report order.
KINDS = ("sca", "container", "sbom", "sast", "secrets", "iac", "signing", "dependency-updates", "ci-hardening")
#: How a tool shows - action name, command, command and sub-command,
#: or bot -, its kind, its name, and whether it is commercial.
TOOLS = (
    ("action", "github/codeql-action", "sast", "CodeQL", False),
    ("action", "aquasecurity/trivy-action", "container", "Trivy", False),
    ("action", "anchore/scan-action", "container", "Grype", False),
    ("action", "anchore/sbom-action", "sbom", "Syft", False),
    ("action", "cyclonedx/gh-node-module-generatebom", "sbom", "CycloneDX", False),
    ("action", "semgrep/semgrep-action", "sast", "Semgrep", False),
    ("action", "returntocorp/semgrep-action", "sast", "Semgrep", False),
    ("action", "snyk/actions", "sca", "Snyk", True),
    ("action", "sonarsource/sonarcloud-github-action", "sast", "SonarCloud", True),
    ("action", "sonarsource/sonarqube-scan-action", "sast", "SonarQube", True),
    ("action", "dependency-check/dependency-check_action", "sca", "OWASP Dependency-Check", False),
    ("action", "google/osv-scanner-action", "sca", "osv-scanner", False),
    ("action", "google/osv-scanner-unified-workflow", "sca", "osv-scanner", False),
    ("action", "gitleaks/gitleaks-action", "secrets", "gitleaks", False),
    ("action", "trufflesecurity/trufflehog", "secrets", "TruffleHog", False),
    ("action", "bridgecrewio/checkov-action", "iac", "Checkov", False),
    ("action", "aquasecurity/tfsec-action", "iac", "tfsec", False),
    ("action", "aquasecurity/tfsec-pr-commenter-action", "iac", "tfsec", False),
    ("action", "sigstore/cosign-installer", "signing", "cosign", False),
    ("action", "sigstore/gh-action-sigstore-python", "signing", "sigstore", False),
    ("action", "slsa-framework/slsa-github-generator", "signing", "SLSA generator", False),
    ("action", "ossf/scorecard-action", "ci-hardening", "OpenSSF Scorecard", False),
    ("action", "step-security/harden-runner", "ci-hardening", "Harden-Runner", True),
    ("action", "snyk/container-action", "container", "Snyk Container", True),
    ("action", "veracode/veracode-uploadandscan-action", "sast", "Veracode", True),
    ("action", "checkmarx/ast-github-action", "sast", "Checkmarx", True),
    ("action", "mend-toolkit/mend-scan-action", "sca", "Mend", True),
    ("action", "fossas/fossa-action", "sca", "FOSSA", True),
    ("command", "trivy", "container", "Trivy", False),
    ("command", "grype", "container", "Grype", False),
    ("command", "dockle", "container", "dockle", False),
    ("command", "hadolint", "container", "hadolint", False),
    ("command", "syft", "sbom", "Syft", False),
    ("command", "cyclonedx", "sbom", "CycloneDX", False),
    ("command", "cyclonedx-py", "sbom", "cyclonedx-py", False),
    ("command", "cdxgen", "sbom", "cdxgen", False),
    ("command", "spdx-sbom-generator", "sbom", "spdx-sbom-generator", False),
    ("command", "semgrep", "sast", "Semgrep", False),
    ("command", "bandit", "sast", "Bandit", False),
    ("command", "codeql", "sast", "CodeQL", False),
    ("command", "gosec", "sast", "gosec", False),
    ("command", "gitleaks", "secrets", "gitleaks", False),
    ("command", "trufflehog", "secrets", "TruffleHog", False),
    ("command", "detect-secrets", "secrets", "detect-secrets", False),
    ("command", "checkov", "iac", "Checkov", False),
    ("command", "tfsec", "iac", "tfsec", False),
    ("command", "kics", "iac", "KICS", False),
    ("command", "terrascan", "iac", "Terrascan", False),
    ("command", "osv-scanner", "sca", "osv-scanner", False),
    ("command", "pip-audit", "sca", "pip-audit", False),
    ("command", "safety", "sca", "Safety", False),
    ("command", "govulncheck", "sca", "govulncheck", False),
    ("command", "snyk", "sca", "Snyk", True),
    ("command", "cosign", "signing", "cosign", False),
    ("command", "sigstore", "signing", "sigstore", False),
    ("command", "slsa-verifier", "signing", "slsa-verifier", False),
    ("subcommand", "npm audit", "sca", "npm audit", False),
    ("subcommand", "pnpm audit", "sca", "pnpm audit", False),
    ("subcommand", "yarn audit", "sca", "yarn audit", False),
    ("subcommand", "cargo audit", "sca", "cargo-audit", False),
    ("subcommand", "cargo deny", "sca", "cargo-deny", False),
    ("subcommand", "bundle audit", "sca", "bundler-audit", False),
    ("subcommand", "composer audit", "sca", "composer audit", False),
    ("subcommand", "docker scout", "container", "Docker Scout", True),
    ("subcommand", "gh attestation", "signing", "gh attestation", False),
    ("bot", "dependabot", "dependency-updates", "Dependabot", False),
    ("bot", "renovate", "dependency-updates", "Renovate", False),
)
MOST_EVIDENCE = 6


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, "how string, name string, kind string, tool string, commercial boolean")


def invocations(commands: DataFrame, column: str = "note") -> DataFrame:
    """Adds ``how, name`` for each program a shell text runs: its base name, and
    the name with its first argument. Mentions after the head are no runs."""
    segment = F.explode(F.split(F.col(column), r"&&|\|\||[;|\r\n]")).alias("__s")
    rows = commands.select("*", segment)
    fields = F.array_remove(F.split(F.trim(F.regexp_replace("__s", r"\s+", " ")), " "), "")
    # leading sudo and VAR=value words are not the program
    skip = F.aggregate(fields, F.lit(0), lambda n, w: F.when((n >= 0) & ((w == "sudo") | w.contains("=")), n + 1).otherwise(F.when(n >= 0, -n - 1).otherwise(n)), lambda n: F.when(n < 0, -n - 1).otherwise(n))
    rows = rows.withColumn("__f", fields).withColumn("__f", F.slice("__f", skip + 1, F.greatest(F.lit(0), F.size("__f") - skip)))
    head = F.lower(F.regexp_extract(F.get("__f", 0), r"([^/]*)$", 1))
    both = F.array(
        F.struct(F.lit("command").alias("how"), head.alias("name")),
        F.struct(F.lit("subcommand").alias("how"), F.concat_ws(" ", head, F.get("__f", 1)).alias("name")),
    )
    return rows.where(F.size("__f") > 0).withColumn("__b", F.explode(both)).select(*commands.columns, "__b.how", "__b.name")


def detect(nodes: DataFrame) -> DataFrame:
    """``kind, tool, commercial, evidence``: controls found on a run's nodes,
    with up to six distinct sources in id order."""
    keys = run_keys(nodes)
    base = nodes.select(*keys, "id", "completeness", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("source", F.lit("")).alias("source"))
    name = F.regexp_extract("id", r"^pkg:git(?:hub|lab)/([^@]*)", 1)
    cols = [*keys, "id", "how", "name", "source"]
    actions = base.where(F.col("id").rlike("^pkg:git(hub|lab)/")).withColumns({"how": F.lit("action"), "name": F.lower(name), "source": F.when(F.col("source") == "", name).otherwise(F.col("source"))})
    bots = base.where(F.col("id").startswith("pkg:generic/unanalysed/")).withColumns({"how": F.lit("bot"), "name": F.regexp_extract("id", r"^pkg:generic/unanalysed/([^@]*)", 1)})
    runs = invocations(base.where((F.col("completeness") == "opaque") & (F.col("note") != "") & ~F.col("id").rlike("^pkg:git(hub|lab)/|^pkg:generic/unanalysed/")))
    # a command that is a control by itself is not read as a sub-command too
    own = [n for how, n, *_ in TOOLS if how == "command"]
    runs = runs.where((F.col("how") == "command") | ~F.substring_index("name", " ", 1).isin(*own))
    met = actions.select(*cols).unionByName(bots.select(*cols)).unionByName(runs.select(*cols)).join(F.broadcast(tools(nodes.sparkSession)), ["how", "name"])
    seen = met.where(F.col("source") != "").groupBy(*keys, "kind", "tool", "source").agg(F.min("id").alias("id"))
    order = Window.partitionBy(*keys, "kind", "tool").orderBy("id", "source")
    shown = seen.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MOST_EVIDENCE)
    evidence = shown.groupBy(*keys, "kind", "tool").agg(F.array_sort(F.collect_list(F.struct("rn", "source"))).alias("e"))
    found = met.groupBy(*keys, "kind", "tool").agg(F.max("commercial").alias("commercial"))
    return found.join(evidence, [*keys, "kind", "tool"], "left").select(*keys, "kind", "tool", "commercial", F.coalesce(F.col("e.source"), F.array().cast("array<string>")).alias("evidence"))


def missing(found: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Kinds without any control; per run if ``runs(run_id)`` is given."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    if runs is None:
        return kinds.join(found.select("kind").distinct(), "kind", "left_anti")
    every = runs.select("run_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    return every.join(found.select("run_id", "kind").distinct(), ["run_id", "kind"], "left_anti")


def assessable(nodes: DataFrame) -> DataFrame:
    """Whether there was any CI to read; absence of controls means nothing else."""
    ci = F.col("id").startswith("pkg:generic/buildfile/workflow@") | F.col("id").startswith("pkg:generic/buildfile/gitlab-ci@")
    return nodes.groupBy(*run_keys(nodes)).agg(F.coalesce(F.bool_or(ci), F.lit(False)).alias("assessable"))
