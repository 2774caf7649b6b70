"""Build files and manifests to dependency edges: one table function.

``extract(files)`` runs every extractor that claims a file's path over its
bytes, batch-wise, and returns one row for each edge with what is known of the
node it leads to. ``from_id`` is null where the repository's root is meant.

An extractor is a path pattern and a generator; extend EXTRACTORS to add one.
A file that an extractor cannot parse gives a frontier row, and the scan goes
on. Files that no extractor claims are matched against a catalogue of known
tools, so that what was not analysed is named.
"""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import DIST_TAGS
from plumbline.functions.versions import parse_semver, poetry_to_pep440

SCHEMA = (
    "path string, extractor string, ord int, from_id string, to_id string, kind string, spec string, scope string, ecosystem string, name string, "
    "version string, completeness string, reason string, resolved_ref string, source string, note string"
)


@dataclass
class Row:
    to_id: str
    from_id: str | None = None
    kind: str = "depends_on"
    spec: str = ""
    scope: str = "prod"
    ecosystem: str | None = None
    name: str | None = None
    version: str = ""
    completeness: str | None = None  # null: only a requirement, no node yet
    reason: str | None = None
    resolved_ref: str | None = None
    note: str | None = None


# --- identities ----------------------------------------------------------------


def digest(text: str, n: int = 12) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def purl(ecosystem: str, name: str, version: str = "", tail: str = "") -> str:
    if ecosystem == "pypi":
        name = re.sub(r"[-_.]+", "-", name.strip().lower())
    path = "/".join(quote(p, safe="-._~:") for p in name.split("/"))
    return f"pkg:{ecosystem}/{path}" + (f"@{quote(version, safe='-._~:')}" if version else "") + tail


def build_file(kind: str, path: str) -> Row:
    return Row(f"pkg:generic/buildfile/{kind}@{digest(path)}#{path}", kind="invokes", ecosystem="generic", name=path.rsplit("/", 1)[-1], version=digest(path), completeness="resolved", note=path)


def hashed(what: str, subject: str, completeness: str, reason: str | None = None, **more) -> Row:
    return Row(f"pkg:generic/{what}@{digest(subject)}", **{"ecosystem": "generic", "name": what, "version": digest(subject), "completeness": completeness, "reason": reason, "note": subject.strip()} | more)


def opaque(command: str, **more) -> Row:
    return hashed("opaque", command, "opaque", kind="installs", **more)


def image(ref: str, **more) -> Row:
    """A container image: digests are resolved, tags move."""
    head, _, sha = ref.partition("@sha256:")
    m = re.match(r"^(.*?)(?::([^/:]*))?$", head)
    name, tag = m[1], m[2] or "latest"
    version = f"sha256:{sha}" if sha else tag
    tail = f"?tag={quote(tag)}" if sha and tag != "latest" else ""
    fixed = bool(re.fullmatch(r"[0-9a-f]{64}", sha))
    return Row(
        purl("oci", name, version, tail), kind="builds_on", ecosystem="oci", name=name.rsplit("/", 1)[-1], version=version,
        completeness="resolved" if fixed else "declared", reason=None if fixed else "unpinned-ref", resolved_ref=version if fixed else None, **more,
    )


def github(uses: str, **more) -> Row:
    spec, _, ref = uses.partition("@")
    org, repo, *rest = spec.split("/") if spec.count("/") else (spec, "")
    if not org or not repo:
        raise ValueError(f"not an action: {uses}")
    fixed = bool(re.fullmatch(r"[0-9a-fA-F]{40}", ref))
    tail = "#" + "/".join(rest) if rest else ""
    return Row(
        purl("github", f"{org}/{repo}", ref, tail), kind="invokes", ecosystem="github", name=f"{org}/{repo}", version=ref,
        completeness="resolved" if fixed else "declared", reason=None if fixed else "unpinned-ref", resolved_ref=ref if fixed else None, **more,
    )


# --- manifests -------------------------------------------------------------------

_LOCAL = ("workspace:", "catalog:", "link:", "file:", "portal:")


def npm_manifest(path: str, text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for field, scope in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, spec in sorted((doc.get(field) or {}).items()):
            alias = re.match(r"^npm:(.+?)(?:@([^@]*))?$", spec)
            if alias:
                name, spec = alias[1], alias[2] or "*"
            yield Row(purl("npm", name), spec="" if spec.startswith(_LOCAL) else spec, scope=scope)


_REQUIREMENT = re.compile(r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*(\(?[^;@]*\)?)?(?:;.*|@.*)?$")


def requirement(text: str) -> tuple[str, str] | None:
    """Name and specifiers of a PEP 508 requirement; null for prose."""
    m = _REQUIREMENT.match(text.strip())
    spec = (m[2] or "").strip().strip("()").strip() if m else ""
    if not m or (spec and not re.fullmatch(r"(?:(?:===|==|!=|<=|>=|~=|<|>)\s*[^\s,]+\s*,?\s*)+", spec)):
        return None
    return m[1], re.sub(r"\s+", "", spec)


def pyproject(path: str, text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)

    def rows(items, scope):
        for item in items:
            parsed = requirement(item)
            if parsed:
                yield Row(purl("pypi", parsed[0]), spec=parsed[1], scope=scope)

    groups = doc.get("dependency-groups") or {}

    def members(name: str, seen: set[str]) -> Iterator[str]:
        if name in seen:
            return
        seen.add(name)
        for item in groups.get(name, []):
            if isinstance(item, str):
                yield item
            elif isinstance(item, dict) and isinstance(item.get("include-group"), str):
                yield from members(item["include-group"], seen)

    project = doc.get("project") or {}
    yield from rows(project.get("dependencies") or [], "prod")
    for _, items in sorted((project.get("optional-dependencies") or {}).items()):
        yield from rows(items, "optional")
    for name in sorted(groups):
        yield from rows(members(name, set()), "dev")


def poetry(path: str, text: str) -> Iterator[Row]:
    try:
        table = (tomllib.loads(text).get("tool") or {}).get("poetry") or {}
    except tomllib.TOMLDecodeError:
        return  # the other pyproject reader reports it

    def rows(dependencies, scope):
        for name, value in sorted((dependencies or {}).items()):
            if isinstance(value, list):
                value = value[0] if value else ""
            value = {"version": value} if isinstance(value, str) else value
            if name.lower() == "python" or any(k in value for k in ("path", "url", "git")):
                continue
            spec = value.get("version", "")
            row = Row(purl("pypi", name), scope="optional" if value.get("optional") else scope)
            row.spec = poetry_to_pep440(spec)
            if row.spec is None:
                row.spec, row.ecosystem, row.name, row.completeness, row.reason, row.note = "", "pypi", name, "declared", "poetry-alternation", spec
            yield row

    yield from rows(table.get("dependencies"), "prod")
    yield from rows(table.get("dev-dependencies"), "dev")
    for _, group in sorted((table.get("group") or {}).items()):
        yield from rows(group.get("dependencies"), "dev")


def requirements_txt(path: str, text: str) -> Iterator[Row]:
    rows, considered, parsed = [], 0, 0
    for raw in text.split("\n"):
        line = re.split(r"\s#", raw.strip(), maxsplit=1)[0].strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("-"):
            m = re.match(r"^(?:--index-url|--extra-index-url|--find-links|-i|-f)\s*=?\s*(\S.*)$", line)
            if m:
                rows.append(hashed("index-url", m[1], "declared", "registry-redirect", kind="installs"))
        elif "://" in line:
            rows.append(hashed("url-requirement", line, "declared", "unpinned-ref"))
        else:
            considered += 1
            got = requirement(line)
            if got:
                parsed += 1
                rows.append(Row(purl("pypi", got[0]), spec=got[1]))
    if considered < 4 or parsed * 2 >= considered:  # else it is prose
        yield from rows


def requirement_gate(lines: DataFrame, pattern: str) -> DataFrame:
    """The same gate natively: ``file, candidates, parsed, rejected`` of text lines."""
    line = F.trim("line")
    rows = lines.where((line != "") & ~line.startswith("#")).withColumn("__ok", line.rlike(pattern))
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("__ok").alias("parsed"))
    return counts.withColumn("rejected", (F.col("candidates") >= 4) & (F.col("parsed") * 2 < F.col("candidates")))


def cargo_manifest(path: str, text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)

    def rows(table, scope):
        for key, value in sorted((table or {}).items()):
            value = {"version": value} if isinstance(value, str) else value
            if "path" in value or "git" in value or value.get("workspace"):
                continue
            yield Row(purl("cargo", value.get("package", key)), spec=value.get("version", ""), scope="optional" if value.get("optional") else scope)

    kinds = (("dependencies", "prod"), ("dev-dependencies", "dev"), ("dev_dependencies", "dev"), ("build-dependencies", "prod"), ("build_dependencies", "prod"))
    for holder in (doc, *[t for _, t in sorted((doc.get("target") or {}).items())]):
        for field, scope in kinds:
            yield from rows(holder.get(field), scope)


def go_mod(text: str) -> tuple[list[tuple[str, str, bool]], dict[tuple[str, str], tuple[str, str]]]:
    """Requires (module, version, indirect) and replaces of a go.mod."""
    requires, replaces, block = [], {}, None
    for raw in text.split("\n"):
        code, _, comment = raw.partition("//")
        words = code.split()
        if not words:
            continue
        if block is None and len(words) >= 2 and words[1] == "(":
            block = words[0]
            continue
        if words[0] == ")":
            block = None
            continue
        verb, args = (block, words) if block else (words[0], words[1:])
        args = [a.strip('"') for a in args]
        if verb == "require" and len(args) >= 2:
            requires.append((args[0], args[1], "indirect" in comment))
        elif verb == "replace" and "=>" in args:
            at = args.index("=>")
            old, new = args[:at], args[at + 1 :]
            if old and new:
                replaces[old[0], old[1] if len(old) > 1 else ""] = (new[0], new[1] if len(new) > 1 else "")
    return requires, replaces


def go_version(v: str) -> str:
    return v.split("+")[0]


def go_manifest(path: str, text: str) -> Iterator[Row]:
    requires, replaces = go_mod(text)
    for module, version, indirect in requires:
        if indirect:
            continue
        to = replaces.get((module, version)) or replaces.get((module, ""))
        if to and (to[0].startswith((".", "/")) or not to[1]):
            yield Row(purl("golang", module), ecosystem="golang", name=module, completeness="declared", reason="local-replace", note=f"replaced by {to[0]}")
            continue
        name, version = to or (module, version)
        v = go_version(version)
        yield Row(purl("golang", name, v), spec=version, ecosystem="golang", name=name, version=v, completeness="resolved", resolved_ref=v)


# --- containers and CI --------------------------------------------------------------

#: Command prefix, package type, distribution family, pin separator.
INSTALLERS = (
    ("apt-get install", "deb", "deb", "="), ("apt install", "deb", "deb", "="), ("apk add", "apk", "apk", "="), ("yum install", "rpm", "rpm", "-"),
    ("dnf install", "rpm", "rpm", "-"), ("microdnf install", "rpm", "rpm", "-"), ("zypper install", "rpm", "rpm", "-"), ("pip install", "pypi", "", "=="),
    ("pip3 install", "pypi", "", "=="), ("uv pip install", "pypi", "", "=="), ("npm install", "npm", "", "@"), ("npm i", "npm", "", "@"),
)
#: Options whose next word is their value.
VALUE_OPTIONS = frozenset(
    "-r --requirement -c --constraint -e --editable -t --target -i --index-url --extra-index-url -f --find-links --trusted-host --python --prefix --root --src "
    "-o --target-release --repository -X --virtual --registry -w --workspace --tag".split()
)
#: Words in an image name, the family and distribution they tell.
DISTRIBUTIONS = (
    (r"alpine", "apk", "alpine"), (r"ubuntu|jammy|noble|focal|bionic|plucky", "deb", "ubuntu"), (r"debian|bookworm|bullseye|trixie|buster|slim", "deb", "debian"),
    (r"rocky", "rpm", "rocky"), (r"almalinux", "rpm", "almalinux"), (r"redhat|ubi8|ubi9|rhel", "rpm", "redhat"), (r"fedora", "rpm", "fedora"), (r"suse", "rpm", "opensuse"),
)
DEFAULT_DISTRIBUTION = {"deb": "debian", "apk": "alpine", "rpm": "redhat"}
_FILE_WORD = re.compile(r"\.(txt|in|toml|cfg|lock|json|ya?ml|sh|whl|tar|gz)$", re.I)
_NAME_WORD = re.compile(r"^(?:@[A-Za-z0-9][A-Za-z0-9._+-]*/[A-Za-z0-9._+-]+|[A-Za-z0-9][A-Za-z0-9._+-]*)$")


def run_packages(command: str, base: str) -> Iterator[Row]:
    """Packages that a shell command installs; the distribution is the base
    image's if it has the command's family, else the family's usual one."""
    here = next(((fam, dist) for words, fam, dist in DISTRIBUTIONS if re.search(words, base.lower())), ("", ""))
    for part in re.split(r"&&|\|\||[;|]", command):
        words = part.split()
        for prefix, kind, family, pin in INSTALLERS:
            head = prefix.split()
            if words[: len(head)] != head:
                continue
            rest = iter(words[len(head) :])
            for word in rest:
                if word.startswith("-"):
                    if word in VALUE_OPTIONS:
                        next(rest, None)
                    continue
                scoped = word.startswith("@") and word.count("/") == 1
                if re.search(r"[$`(){}*]", word) or ("/" in word and not scoped) or _FILE_WORD.search(word):
                    continue
                at = word.rfind(pin)
                name, version = word, ""
                if at > 0 and (pin != "-" or word[at + 1 : at + 2].isdigit()):
                    name, version = word[:at], word[at + len(pin) :]
                if version.lower() in DIST_TAGS:
                    version = ""
                if not _NAME_WORD.match(name):
                    continue
                space = (here[1] if here[0] == family else DEFAULT_DISTRIBUTION[family]) + "/" if family else ""
                assumed = bool(family) and here[0] != family
                yield Row(
                    purl(kind, space + name, version), kind="installs", ecosystem=kind, name=name, version=version, completeness="inferred",
                    reason="inferred:run,distro-assumed" if assumed else "inferred:run", note=part.strip(),
                )
            break


def _instructions(text: str) -> Iterator[tuple[str, str]]:
    lines = text.replace("\r\n", "\n").split("\n")
    escape = "\\"
    for line in lines:
        if line.strip() and not line.strip().startswith("#"):
            break
        m = re.match(r"^\s*#\s*escape\s*=\s*(\S)\s*$", line, re.I)
        escape = m[1] if m else escape
    held = ""
    for line in lines:
        line = line.rstrip(" \t")
        if line.lstrip().startswith("#") or (not held and not line.strip()):
            continue
        if line.endswith(escape):
            held += line[:-1] + " "
            continue
        verb, _, rest = (held + line).strip().partition(" ")
        held = ""
        if verb:
            yield verb.upper(), rest.strip()


def _expand(text: str, values: dict[str, str]) -> tuple[str, bool]:
    whole = True

    def one(m: re.Match) -> str:
        nonlocal whole
        value = values.get(m[1] or m[3])
        default = re.match(r"^:?-(.+)$", m[2] or "")
        if value or default:
            return value or default[1]
        whole = False
        return m[0]

    out = re.sub(r"\$\{([A-Za-z_]\w*)(:?[-+][^}]*)?\}|\$([A-Za-z_]\w*)", one, text)
    return out, whole


def dockerfile(path: str, text: str) -> Iterator[Row]:
    file = build_file("dockerfile", path)
    yield file
    values, stages, base = {}, set(), ""
    for verb, rest in _instructions(text):
        if verb == "ARG" and "=" in rest:
            key, _, value = rest.partition("=")
            values[key.strip()] = value.strip().strip("\"'") if value.strip()[:1] in "\"'" else value.strip()
        elif verb == "FROM":
            words = [w for w in rest.split() if not w.startswith("--")]
            if not words:
                continue
            if len(words) >= 3 and words[1].upper() == "AS":
                stages.add(words[2].lower())
            ref, whole = _expand(words[0], values)
            if {words[0].lower(), ref.lower()} & (stages | {"scratch"}):
                continue
            base = ref if whole else ""
            if whole:
                yield image(ref.removeprefix("docker.io/library/"), from_id=file.to_id)
            else:
                yield hashed("unresolved-image", ref, "declared", "unresolved-arg", from_id=file.to_id, kind="builds_on", ecosystem="oci", name=ref, note=f"FROM {ref}")
        elif verb == "RUN" and rest:
            yield opaque(rest, from_id=file.to_id)
            for row in run_packages(rest, base):
                row.from_id = file.to_id
                yield row


def _yaml(text: str):
    import yaml

    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def workflow(path: str, text: str) -> Iterator[Row]:
    file = build_file("workflow", path)
    yield file
    local = ("./", "../")
    for _, job in sorted(_dict(_dict(_yaml(text)).get("jobs")).items(), key=lambda x: str(x[0])):
        job = _dict(job)
        if job.get("uses") and not job["uses"].startswith(local):
            yield github(job["uses"], from_id=file.to_id)
        container = job.get("container")
        container = container.get("image") if isinstance(container, dict) else container
        if container:
            yield image(container, from_id=file.to_id)
        for step in job.get("steps") or []:
            uses, run = _dict(step).get("uses"), _dict(step).get("run")
            if uses and uses.startswith("docker://"):
                yield image(uses.removeprefix("docker://"), from_id=file.to_id)
            elif uses and not uses.startswith(local):
                yield github(uses, from_id=file.to_id)
            elif not uses and run:
                yield opaque(run, from_id=file.to_id)


#: Top-level keys of a GitLab pipeline that are no jobs.
GITLAB_RESERVED = frozenset("include stages variables workflow image services before_script after_script cache pages".split())


def _include(item, path_claimed: Callable[[str], bool]) -> Row | None:
    if isinstance(item, str):
        item = {"remote": item} if re.match(r"https?://", item) else {"local": item}
    pinned = lambda v: {"completeness": "resolved", "reason": None} if v else {"completeness": "declared", "reason": "unpinned-ref"}
    if item.get("component"):
        spec, _, version = item["component"].partition("@")
        name = spec.removeprefix("gitlab.com/")
        return Row(purl("gitlab", name, version), kind="invokes", ecosystem="gitlab", name=name, version=version, **pinned(version)) if "/" in name else None
    if item.get("project"):
        ref, files = item.get("ref") or "", item.get("file") or ""
        files = ",".join(f for f in files if isinstance(f, str)) if isinstance(files, list) else files
        return Row(purl("gitlab", item["project"], ref, f"#{files.strip('/')}" if files else ""), kind="invokes", ecosystem="gitlab", name=item["project"], version=ref, **pinned(ref))
    if item.get("remote"):
        return hashed("remote-include", item["remote"], "declared", "unpinned-ref", kind="invokes")
    if item.get("template"):
        return hashed("gitlab-template", item["template"], "declared", "unpinned-ref", kind="invokes")
    if item.get("local") and not path_claimed(item["local"].lstrip("/")):
        return hashed("local-include", item["local"], "declared", "no-extractor", kind="invokes")
    return None


def gitlab_ci(path: str, text: str) -> Iterator[Row]:
    file = build_file("gitlab-ci", path)
    yield file
    claimed = lambda p: bool(re.search(CLAIMS["gitlab-ci"], p))
    name = lambda x: x.get("name") if isinstance(x, dict) else x
    for key, value in sorted(_dict(_yaml(text)).items(), key=lambda x: str(x[0])):
        rows: list[Row | None] = []
        if key == "include":
            rows = [_include(i, claimed) for i in (value if isinstance(value, list) else [value])]
        elif key not in GITLAB_RESERVED and isinstance(value, dict):
            refs = [name(value.get("image")), *[name(s) for s in value.get("services") or []]]
            rows = [image(r) for r in refs if isinstance(r, str) and r]
            for block in ("before_script", "script", "after_script"):
                script = value.get(block) or []
                script = [script] if isinstance(script, str) else [s for s in script if isinstance(s, str)]
                if script:
                    rows.append(opaque("\n".join(script)))
        for row in filter(None, rows):
            row.from_id = file.to_id
            yield row


def pre_commit(path: str, text: str) -> Iterator[Row]:
    file = build_file("pre-commit", path)
    yield file
    for repo in _dict(_yaml(text)).get("repos") or []:
        url, rev = str(_dict(repo).get("repo") or ""), str(_dict(repo).get("rev") or "")
        m = re.match(r"^(?:https?://|git@)github\.com[/:]([^/]+)/(.+?)(?:\.git)?/?$", url)
        if m:
            yield github(f"{m[1]}/{m[2]}@{rev}", from_id=file.to_id)
        elif url and url not in ("local", "meta"):
            yield hashed("hook-repo", f"{url}@{rev}", "declared", "unpinned-ref", from_id=file.to_id, kind="invokes")
        for hook in _dict(repo).get("hooks") or []:
            for dependency in _dict(hook).get("additional_dependencies") or []:
                got = requirement(str(dependency))
                if got:
                    yield Row(purl("pypi", got[0]), from_id=file.to_id, spec=got[1], scope="dev")


# --- Terraform ----------------------------------------------------------------------


def _hcl(text: str) -> tuple[str, list[tuple[str, str]], list[tuple[str, str]]]:
    """Required version, providers and modules (source, version)."""
    required, providers, modules, stack = "", [], [], []
    for raw in text.split("\n"):
        line = re.match(r'^(?:[^"#/]|"(?:[^"\\]|\\.)*"|/(?!/))*', raw)[0].strip()
        if not line:
            continue
        if line.startswith("}"):
            kind, name, found = stack.pop() if stack else ("", "", {})
            if kind == "provider":
                providers.append((found.get("source") or name, found.get("version", "")))
            elif kind == "module":
                modules.append((found.get("source", ""), found.get("version", "")))
            continue
        inside = any(k == "required_providers" for k, *_ in stack)
        block = re.match(r'^([A-Za-z_][\w-]*)(?:\s*=)?(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?\s*\{\s*$', line)
        if block:
            stack.append(("provider" if inside else block[1], block[1], {}))
            continue
        one = re.match(r"^([A-Za-z_][\w-]*)\s*=\s*\{(.*)\}\s*$", line)
        if one and inside:
            found = dict(re.findall(r'([A-Za-z_][\w-]*)\s*=\s*"([^"]*)"', one[2]))
            providers.append((found.get("source") or one[1], found.get("version", "")))
            continue
        pair = re.match(r'^([A-Za-z_][\w-]*)\s*=\s*"([^"]*)"', line)
        if pair and stack:
            stack[-1][2][pair[1]] = pair[2]
            if pair[1] == "required_version" and any(k == "terraform" for k, *_ in stack):
                required = pair[2]
    return required, providers, modules


def provider_id(source: str, version: str = "") -> str:
    parts = source.strip().split("/")[-2:]
    return purl("terraform", "/".join(parts if len(parts) == 2 else ["hashicorp", *parts]), version)


def terraform(path: str, text: str) -> Iterator[Row]:
    required, providers, modules = _hcl(text)
    if required:
        yield Row("pkg:terraform-cli/hashicorp/terraform", kind="builds_on", spec=required, ecosystem="terraform-cli", name="terraform", completeness="declared", reason="unpinned-ref")
    for source, version in providers:
        if source.strip():
            yield Row(provider_id(source), spec=version)
    for source, version in modules:
        source = source.strip()
        if not source or source.startswith(("./", "../")):
            continue
        parts = source.split("/")
        if len(parts) == 3 and "::" not in source and ".git" not in source:
            yield Row(purl("terraform-module", f"{parts[0]}/{parts[1]}-{parts[2]}", version), spec=version, ecosystem="terraform-module", name=source, version=version, completeness="declared", reason="unpinned-ref")
        else:
            safe = re.sub(r"[^A-Za-z0-9._-]+", "-", source).strip("-")
            yield Row(purl("generic", f"terraform-module/{safe}", version), spec=version, ecosystem="generic", name=source, version=version, completeness="declared", reason="vcs-module", note=source)


def terraform_pin(path: str, text: str) -> Iterator[Row]:
    if path.rsplit("/", 1)[-1] == ".terraform-version":
        version = text.strip()
    else:
        version = next((w[1] for w in (line.split() for line in text.split("\n")) if len(w) >= 2 and w[0] == "terraform"), "")
    if version and not version.startswith("latest") and parse_semver("terraform", version):
        yield Row(purl("terraform-cli", "hashicorp/terraform", version), kind="builds_on", spec=version, ecosystem="terraform-cli", name="terraform", version=version, completeness="resolved", resolved_ref=version)


# --- dispatch -----------------------------------------------------------------------

_ENV = r"(?!(?:.*/)?(?:\.venv|venv|site-packages|node_modules)/)"
#: Path patterns; several extractors may claim one file.
CLAIMS: dict[str, str] = {
    "npm-manifest": r"^(?!(?:.*/)?node_modules/)(?:.*/)?package\.json$",
    "pyproject": rf"^{_ENV}(?:.*/)?pyproject\.toml$",
    "poetry": rf"^{_ENV}(?:.*/)?pyproject\.toml$",
    "requirements": rf"^{_ENV}(?:requirements/[^/]*\.txt|(?:.*/)?(?:requirements|constraints)[^/]*\.(?:txt|in))$",
    "cargo": r"^(?!(?:.*/)?(?:target|vendor)/)(?:.*/)?Cargo\.toml$",
    "gomod": r"^(?!(?:.*/)?(?:vendor|testdata)/)(?:.*/)?go\.mod$",
    "dockerfile": r"^(?!(?:.*/)?(?:node_modules|vendor)/)(?:.*/)?(?:Dockerfile(?:\.[^/]*)?|[^/]*\.[Dd]ockerfile)$",
    "workflow": r"^\.github/workflows/[^/]+\.ya?ml$",
    "gitlab-ci": r"^(?:(?:.*/)?\.gitlab-ci[^/]*\.ya?ml|\.gitlab/.*\.ya?ml)$",
    "pre-commit": r"^(?:.*/)?\.pre-commit-config\.ya?ml$",
    "terraform": r"^(?!(?:.*/)?\.terraform/)(?:.*/)?[^/]+\.tf$",
    "terraform-version": r"^(?:.*/)?\.(?:terraform-version|tool-versions)$",
}
EXTRACTORS: dict[str, Callable[[str, str], Iterator[Row]]] = {
    "npm-manifest": npm_manifest, "pyproject": pyproject, "poetry": poetry, "requirements": requirements_txt, "cargo": cargo_manifest, "gomod": go_manifest,
    "dockerfile": dockerfile, "workflow": workflow, "gitlab-ci": gitlab_ci, "pre-commit": pre_commit, "terraform": terraform, "terraform-version": terraform_pin,
}


def claims(path: Column) -> Column:
    """Names of the extractors that claim a path, natively."""
    return F.array_compact(F.array(*[F.when(path.rlike(p), F.lit(name)) for name, p in CLAIMS.items()]))


def rows_of(path: str, content: bytes) -> Iterator[dict]:
    """All rows of one file."""
    found = False
    for name, pattern in CLAIMS.items():
        if not re.search(pattern, path):
            continue
        found = True
        try:
            rows = list(EXTRACTORS[name](path, content.decode("utf-8", "replace")))
        except Exception as error:  # whatever a parser raises is a fact about the file
            base = path.rsplit("/", 1)[-1]
            subject = f"{name}\0{path}"
            rows = [Row(f"pkg:generic/unparsed/{quote(base)}@{digest(subject)}#{path}", kind="installs", ecosystem="generic", name=base, version=digest(subject), completeness="declared", reason="error:parse", note=f"{name}: {error}")]
        # a pin file that pins nothing here leaves the file to the catalogue
        if name == "terraform-version" and not rows:
            found = False
        for i, row in enumerate(rows):
            yield {"path": path, "extractor": name, "ord": i, "source": path} | asdict(row)
    if not found:
        from plumbline.sources.toolbox import lookup

        hit = lookup(path)
        if hit:
            tool, category = hit
            row = Row(f"pkg:generic/unanalysed/{tool}@{digest(path)}?category={category}", kind="installs", ecosystem="generic", name=tool, version=digest(path), completeness="declared", reason="no-extractor", note=f"{tool} ({category}) not yet expanded: {path}")
            yield {"path": path, "extractor": "coverage", "ord": 0, "source": path} | asdict(row)


def extract(files: DataFrame) -> DataFrame:
    """Edges of ``files(path, content[, run_id])``, with their run if given."""
    keyed = "run_id" in files.columns
    schema = ("run_id string, " if keyed else "") + SCHEMA
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                extra = {"run_id": rec.run_id} if keyed else {}
                rows += [r | extra for r in rows_of(rec.path, bytes(rec.content) if rec.content is not None else b"")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(*(["run_id"] if keyed else []), "path", "content").mapInPandas(run, schema)


def edges_and_nodes(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractor rows as ``edges`` (with the root filled in) and ``nodes``."""
    keys = ["run_id"] if "run_id" in rows.columns and "run_id" in roots.columns else []
    root = roots.select(*keys, F.col("id").alias("__root"))
    filled = rows.join(F.broadcast(root), keys) if keys else rows.join(F.broadcast(root))
    edges = filled.select(*keys, F.coalesce("from_id", "__root").alias("from_id"), "to_id", "kind", F.coalesce("spec", F.lit("")).alias("spec"), "scope", F.lit("declared").alias("origin"), "path", "ord")
    nodes = filled.where("completeness IS NOT NULL").select(*keys, F.col("to_id").alias("id"), "ecosystem", "name", "version", "completeness", "reason", "resolved_ref", "source", "note", "ord")
    return edges, nodes
