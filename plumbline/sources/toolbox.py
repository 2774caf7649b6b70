"""Files of tools that no extractor reads, so that they are at least named."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tool, category, base names (``dir:`` and ``re:`` are patterns on
#: the folder and on the base name). The first match names the file.
TOOLS = (
    ("husky", "hook", r"dir:^\.husky re:^\.huskyrc(\.json|\.js)?$ husky.config.js"),
    ("lefthook", "hook", "lefthook.yml lefthook.yaml lefthook.toml .lefthook.yml .lefthook.yaml"),
    ("simple-git-hooks", "hook", ".simple-git-hooks.json simple-git-hooks.json"),
    ("lint-staged", "hook", ".lintstagedrc .lintstagedrc.json .lintstagedrc.js lint-staged.config.js"),
    ("commitlint", "hook", r"re:^(commitlint\.config\.|\.commitlintrc)"),
    ("overcommit", "hook", ".overcommit.yml"),
    ("danger", "hook", r"Dangerfile re:^dangerfile\."),
    ("githooks-dir", "hook", r"dir:^\.?githooks$"),
    ("direnv", "hook", ".envrc"),
    ("pnpm-hooks", "hook", ".pnpmfile.cjs pnpmfile.js .pnpmfile.js"),
    ("patch-package", "hook", r"in:^patches$,\.patch$"),
    ("npm", "lockfile", "npm-shrinkwrap.json"),
    ("pnpm", "manifest", "pnpm-workspace.yaml"),
    ("yarn-berry", "hook", r"dir:^\.yarn/(releases|plugins)"),
    ("bun", "lockfile", "bun.lockb"),
    ("bun", "manifest", "bunfig.toml"),
    ("deno", "manifest", "deno.json deno.jsonc"),
    ("deno", "lockfile", "deno.lock"),
    ("deno", "manifest", "import_map.json importMap.json"),
    ("jsr", "manifest", "jsr.json jsr.jsonc"),
    ("js-monorepo", "orchestrator", "lerna.json nx.json turbo.json rush.json"),
    ("volta", "toolchain", ".volta.json"),
    ("node-version", "toolchain", ".nvmrc .node-version"),
    ("npm-registry", "registry-config", ".npmrc .yarnrc .yarnrc.yml"),
    ("setuptools", "manifest", "setup.py setup.cfg MANIFEST.in"),
    ("poetry", "manifest", "poetry.toml"),
    ("pipenv", "manifest", "Pipfile"),
    ("pipenv", "lockfile", "Pipfile.lock"),
    ("pdm", "lockfile", "pdm.lock"),
    ("pdm", "manifest", "pdm.toml .pdm-python"),
    ("uv", "manifest", "uv.toml"),
    ("rye", "lockfile", "requirements.lock requirements-dev.lock"),
    ("hatch", "manifest", "hatch.toml"),
    ("pixi", "manifest", "pixi.toml"),
    ("pixi", "lockfile", "pixi.lock"),
    ("conda", "manifest", "environment.yml environment.yaml meta.yaml"),
    ("conda", "lockfile", "conda-lock.yml conda-lock.yaml"),
    ("conda", "registry-config", ".condarc"),
    ("tox", "orchestrator", "tox.ini"),
    ("nox", "orchestrator", "noxfile.py"),
    ("buildout", "manifest", "buildout.cfg"),
    ("pyenv", "toolchain", ".python-version"),
    ("pypi-registry", "registry-config", "pip.conf .pypirc"),
    ("docker", "manifest", r"Dockerfile re:^Dockerfile\. re:\.dockerfile$"),
    ("docker-compose", "orchestrator", "docker-compose.yml docker-compose.yaml compose.yml compose.yaml"),
    ("terraform", "manifest", r"re:\.tfvars$"),
    ("helm", "manifest", "Chart.yaml"),
    ("helm", "lockfile", "Chart.lock"),
    ("kustomize", "orchestrator", "kustomization.yaml kustomization.yml"),
    ("skaffold", "orchestrator", "skaffold.yaml"),
    ("ansible", "manifest", "ansible.cfg galaxy.yml site.yml requirements.yml re:^playbook"),
    ("vagrant", "orchestrator", "Vagrantfile"),
    ("devcontainer", "orchestrator", r"devcontainer.json .devcontainer.json dir:^\.devcontainer"),
    ("mise", "toolchain", ".mise.toml mise.toml .mise/config.toml"),
    ("asdf", "toolchain", ".tool-versions"),
    ("proto", "toolchain", ".prototools"),
    ("nix", "manifest", "flake.nix default.nix shell.nix"),
    ("nix", "lockfile", "flake.lock"),
    ("homebrew", "manifest", "Brewfile"),
    ("homebrew", "lockfile", "Brewfile.lock.json"),
    ("go", "lockfile", "go.sum"),
    ("maven", "manifest", "pom.xml"),
    ("gradle", "manifest", "build.gradle build.gradle.kts libs.versions.toml"),
    ("bundler", "manifest", "Gemfile"),
    ("bundler", "lockfile", "Gemfile.lock"),
    ("composer", "manifest", "composer.json"),
    ("composer", "lockfile", "composer.lock"),
    ("nuget", "manifest", r"paket.dependencies re:\.csproj$"),
    ("nuget", "lockfile", "packages.lock.json"),
    ("swift", "manifest", "Package.swift"),
    ("swift", "lockfile", "Package.resolved"),
    ("cocoapods", "manifest", "Podfile"),
    ("cocoapods", "lockfile", "Podfile.lock"),
    ("pub", "manifest", "pubspec.yaml"),
    ("pub", "lockfile", "pubspec.lock"),
    ("bazel", "orchestrator", "WORKSPACE WORKSPACE.bazel MODULE.bazel MODULE.bazel.lock"),
    ("pants", "orchestrator", "pants.toml"),
    ("earthly", "orchestrator", "Earthfile"),
    ("dagger", "orchestrator", "dagger.json"),
    ("git-submodules", "manifest", ".gitmodules"),
    ("make", "orchestrator", "Makefile makefile GNUmakefile"),
    ("just", "orchestrator", "justfile Justfile .justfile"),
    ("task", "orchestrator", "Taskfile.yml Taskfile.yaml"),
    ("ci", "orchestrator", "Jenkinsfile azure-pipelines.yml .drone.yml bitbucket-pipelines.yml cloudbuild.yaml .travis.yml buildkite.yml .woodpecker.yml"),
    ("ci", "orchestrator", r"in:^\.circleci$,^config\."),
    ("local-action", "orchestrator", r"in:\.github,^action\.ya?ml$"),
    ("bootstrap-script", "hook", "install.sh bootstrap.sh setup.sh get.sh"),
    ("renovate", "bot", "renovate.json renovate.json5 .renovaterc .renovaterc.json"),
    ("dependabot", "bot", "dependabot.yml dependabot.yaml"),
)
#: Folders whose files belong to someone else.
SKIPPED = frozenset(("node_modules", "vendor", "third_party", "testdata", ".git"))


def _matches(rule: str, folder: str, base: str) -> bool:
    for word in rule.split(" "):
        if word.startswith("dir:"):
            hit = bool(re.search(word[4:], folder))
        elif word.startswith("re:"):
            hit = bool(re.search(word[3:], base))
        elif word.startswith("in:"):
            where, what = word[3:].split(",", 1)
            hit = bool(re.search(where, folder) and re.search(what, base))
        else:
            hit = base == word
        if hit:
            return True
    return False


def lookup(path: str) -> tuple[str, str] | None:
    """Tool and category of a path, if it is in the catalogue."""
    folder, _, base = path.rpartition("/")
    if SKIPPED & set(folder.split("/")):
        return None
    return next(((tool, category) for tool, category, rule in TOOLS if _matches(rule, folder, base)), None)


def catalogue(spark: SparkSession) -> DataFrame:
    """``tool, category``: what the catalogue knows, each pair once."""
    return spark.createDataFrame(sorted({(t, c) for t, c, _ in TOOLS}), "tool string, category string")
