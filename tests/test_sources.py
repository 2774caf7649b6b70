import json

import pytest

from plumbline.sources import extractors as X
from plumbline.sources import files, lockfiles, toolbox


def rows(path, text):
    return list(X.rows_of(path, text.encode()))


def targets(path, text):
    return {r["to_id"]: r for r in rows(path, text)}


def test_npm_manifest_scopes_aliases_and_protocols():
    got = targets("package.json", json.dumps({"dependencies": {"a": "^1", "w": "workspace:*"}, "devDependencies": {"@t/x": "npm:real@^2"}, "peerDependencies": {"@s/p": ">=1"}, "optionalDependencies": {"o": "1"}}))
    assert {k: (r["spec"], r["scope"]) for k, r in got.items()} == {
        "pkg:npm/a": ("^1", "prod"), "pkg:npm/w": ("", "prod"), "pkg:npm/real": ("^2", "dev"), "pkg:npm/%40s/p": (">=1", "peer"), "pkg:npm/o": ("1", "optional"),
    }
    assert not rows("node_modules/x/package.json", "{}")


def test_pyproject_groups_and_poetry():
    text = """
[project]
dependencies = ["Requests[socks] >=2,<3 ; python_version > '3'", "flask"]
optional-dependencies = {x = ["a.b==1"]}
[dependency-groups]
dev = ["pytest", {include-group = "lint"}]
lint = ["ruff>=0.1", {include-group = "dev"}]
[tool.poetry.dependencies]
python = "^3.9"
django = "^4.2"
local = {path = "../x"}
alt = "^1 || ^2"
opt = {version = "1.0", optional = true}
"""
    got = [(r["extractor"], r["to_id"], r["spec"], r["scope"], r["reason"]) for r in rows("pyproject.toml", text)]
    assert ("pyproject", "pkg:pypi/requests", ">=2,<3", "prod", None) in got and ("pyproject", "pkg:pypi/a-b", "==1", "optional", None) in got
    assert ("pyproject", "pkg:pypi/ruff", ">=0.1", "dev", None) in got and ("poetry", "pkg:pypi/django", ">=4.2,<5.0.0", "prod", None) in got
    assert ("poetry", "pkg:pypi/alt", "", "prod", "poetry-alternation") in got and ("poetry", "pkg:pypi/opt", "==1.0", "optional", None) in got
    assert not any("local" in g[1] or g[1].endswith("/python") for g in got)


def test_requirements_options_urls_and_prose():
    got = targets("requirements.txt", "--index-url https://x/simple\nflask==2.0  # web\ngit+https://x/y.git\n-e .\n")
    assert sorted(r["reason"] or r["spec"] for r in got.values()) == ["==2.0", "registry-redirect", "unpinned-ref"]
    assert not rows("requirements-notes.txt", "We need many things here\nfor this to work we must\ninstall a lot of stuff\nand then pray to it\n")


def test_dockerfile_stages_args_and_packages():
    text = "# escape=`\nARG V=3.19\nFROM --platform=$P alpine:$V AS base\nRUN apk add --virtual .x curl=8.1 `\n  git\nFROM base\nFROM scratch\nFROM $MISSING\nFROM ubuntu@sha256:%s\nRUN apt-get install -y vim && pip install -r r.txt flask==2.0 && npm i @s/p@1.2 left@latest\nRUN yum install nss-softokn-3.1\n" % ("a" * 64)
    got = targets("Dockerfile", text)
    assert {"pkg:oci/alpine@3.19", "pkg:apk/alpine/curl@8.1", "pkg:apk/alpine/git", "pkg:deb/ubuntu/vim", "pkg:pypi/flask@2.0", "pkg:npm/%40s/p@1.2", "pkg:npm/left", "pkg:rpm/redhat/nss-softokn@3.1"} <= set(got)
    assert got["pkg:rpm/redhat/nss-softokn@3.1"]["reason"] == "inferred:run,distro-assumed"
    image = next(r for k, r in got.items() if k.startswith("pkg:oci/ubuntu"))
    assert image["completeness"] == "resolved" and any(r["reason"] == "unresolved-arg" for r in got.values()) and not any("base" in k or "scratch" in k for k in got if k.startswith("pkg:oci"))


def test_workflow_gitlab_and_pre_commit():
    sha = "b" * 40
    got = targets(".github/workflows/ci.yml", f"jobs:\n  a:\n    container: node:20\n    steps:\n    - uses: actions/checkout@v4\n    - uses: o/r/sub@{sha}\n    - uses: ./local\n    - uses: docker://alpine:3\n    - run: make\n")
    assert got["pkg:github/actions/checkout@v4"]["reason"] == "unpinned-ref" and got[f"pkg:github/o/r@{sha}#sub"]["completeness"] == "resolved"
    assert {"pkg:oci/node@20", "pkg:oci/alpine@3"} <= set(got) and sum(r["completeness"] == "opaque" for r in got.values()) == 1
    got = targets(".gitlab-ci.yml", "include:\n- project: g/p\n  ref: v1\n  file: /t.yml\n- component: gitlab.com/c/d@1.0\n- remote: https://x/y.yml\n- local: /.gitlab/x.yml\n- local: other.yml\njob:\n  image: {name: 'ruby:3'}\n  services: ['pg:15']\n  script: [a, b]\n")
    assert {"pkg:gitlab/g/p@v1#t.yml", "pkg:gitlab/c/d@1.0", "pkg:oci/ruby@3", "pkg:oci/pg@15"} <= set(got)
    assert {r["reason"] for r in got.values() if r["completeness"] == "declared"} == {"unpinned-ref", "no-extractor"}
    got = targets(".pre-commit-config.yaml", "repos:\n- repo: https://github.com/o/h.git\n  rev: v1\n  hooks:\n  - id: x\n    additional_dependencies: ['types-x==1']\n- repo: local\n  hooks: []\n")
    assert "pkg:github/o/h@v1" in got and got["pkg:pypi/types-x"]["scope"] == "dev"


def test_terraform_and_go_and_cargo():
    got = targets("main.tf", 'terraform {\n  required_version = ">= 1.5" # "x\n  required_providers {\n    aws = {\n      source = "hashicorp/aws"\n      version = "~> 5.0"\n    }\n    null = { source = "registry.terraform.io/h/null", version = "3.0" }\n  }\n}\nmodule "m" {\n  source = "a/b/c"\n  version = "1.0"\n}\nmodule "l" {\n  source = "./x"\n}\nmodule "g" {\n  source = "git::https://x/y.git"\n}\n')
    assert got["pkg:terraform/hashicorp/aws"]["spec"] == "~> 5.0" and got["pkg:terraform/h/null"]["spec"] == "3.0" and got["pkg:terraform-module/a/b-c@1.0"]["spec"] == "1.0"
    assert got["pkg:terraform-cli/hashicorp/terraform"]["spec"] == ">= 1.5" and any(r["reason"] == "vcs-module" for r in got.values())
    got = targets("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v2.0.0+incompatible\n\tgithub.com/i/i v1.0.0 // indirect\n)\nrequire github.com/l/l v1.0.0\nreplace github.com/l/l => ../l\nreplace github.com/a/b => github.com/f/b v1.3.0\n")
    assert {"pkg:golang/github.com/f/b@v1.3.0", "pkg:golang/github.com/c/d@v2.0.0", "pkg:golang/github.com/l/l"} == set(got) and got["pkg:golang/github.com/l/l"]["reason"] == "local-replace"
    got = targets("Cargo.toml", '[dependencies]\na = "1"\nren = {version = "2", package = "real"}\np = {path = "x"}\n[dev-dependencies]\nd = "3"\n[target."cfg(unix)".dependencies]\nu = {version = "4", optional = true}\n')
    assert {k: (r["spec"], r["scope"]) for k, r in got.items()} == {"pkg:cargo/a": ("1", "prod"), "pkg:cargo/real": ("2", "prod"), "pkg:cargo/d": ("3", "dev"), "pkg:cargo/u": ("4", "optional")}


def test_parse_errors_and_unread_tools_are_named():
    assert rows("package.json", "{")[0]["reason"] == "error:parse"
    assert rows(".husky/pre-commit", "x")[0]["name"] == "husky" and rows(".tool-versions", "nodejs 20\n")[0]["name"] == "asdf"
    assert not rows("src/main.py", "x") and toolbox.lookup("vendor/go.sum") is None


LOCKS = {
    "sub/package-lock.json": ('{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2"}, "node_modules/l": {"link": true}}}', {"pkg:npm/a@1", "pkg:npm/%40s/b@2"}),
    "pnpm-lock.yaml": ("packages:\n  /a/1.0.0: {}\n  '@s/b@2.0.0(peer@1)': {}\n", {"pkg:npm/a@1.0.0", "pkg:npm/%40s/b@2.0.0"}),
    "yarn.lock": ('# yarn\n"@s/b@^1", b@^2:\n  version "1.5.0"\na@^1:\n  version "1.0.0"\n', {"pkg:npm/%40s/b@1.5.0", "pkg:npm/a@1.0.0"}),
    "x/yarn.lock": ('__metadata:\n  version: 8\n"a@npm:^1":\n  version: 1.2.0\n  resolution: "a@npm:1.2.0"\n"w@workspace:.":\n  version: 0.0.0\n  resolution: "w@workspace:."\n', {"pkg:npm/a@1.2.0"}),
    "bun.lock": ('{ // c\n"packages": {"a": ["a@1.0.0", "http://x//y", {},], "w": ["w@workspace:w"],},\n}', {"pkg:npm/a@1.0.0"}),
    "Cargo.lock": ('[[package]]\nname="a"\nversion="1"\nsource="r"\n[[package]]\nname="me"\nversion="0"\n[[package]]\nname="a"\nversion="2"\nsource="r"\n', {"pkg:cargo/a@1", "pkg:cargo/a@2"}),
    "poetry.lock": ('[[package]]\nname="A_b"\nversion="1"\n', {"pkg:pypi/a-b@1"}),
    "uv.lock": ('[[package]]\nname="a"\nversion="1"\n[[package]]\nname="me"\nversion="0"\nsource={virtual="."}\n', {"pkg:pypi/a@1"}),
    ".terraform.lock.hcl": ('provider "registry.terraform.io/hashicorp/aws" {\n  version = "5.1.0"\n}\n', {"pkg:terraform/hashicorp/aws@5.1.0"}),
    "go.mod": ("require a.b/c v1.0.0 // indirect\n", {"pkg:golang/a.b/c@v1.0.0"}),
}


@pytest.mark.parametrize("path", LOCKS)
def test_lockfiles(path):
    text, want = LOCKS[path]
    assert {r["node_id"] for r in lockfiles.instances_of(path, text.encode())} == want


def test_nested_npm_locks_keep_parents_and_errors_are_rows():
    got = {r["locator"]: r["parent_locator"] for r in lockfiles.instances_of("sub/package-lock.json", LOCKS["sub/package-lock.json"][0].encode())}
    assert got == {"sub/node_modules/a": None, "sub/node_modules/a/node_modules/@s/b": "sub/node_modules/a"}
    assert next(lockfiles.instances_of("package-lock.json", b"{"))["error"]


def test_scan_reads_claimed_files_only(spark, tmp_path):
    for p in ("package.json", "src/a.py", "node_modules/x/package.json", ".github/workflows/ci.yml", "sub dir/.gitlab-ci.yml"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    got = {r["path"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"package.json", ".github/workflows/ci.yml", "sub dir/.gitlab-ci.yml"}


def test_unknown_commits_name_the_closest(spark):
    s = spark.createDataFrame([("abc1", "p", bytearray(b"x"))], "commit string, path string, content binary")
    assert files.at_commit(s, "abc1").count() == 1
    with pytest.raises(LookupError, match="abc1"):
        files.at_commit(s, "abd1")
