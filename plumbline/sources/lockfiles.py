"""Lockfiles to installed instances: one table function over file bytes."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.extractors import _dict, _yaml, go_mod, go_version, provider_id, purl

SCHEMA = "path string, reader string, locator string, node_id string, parent_locator string, derived_from string, error string"

Instance = tuple[str, str, str | None]  # locator, node, parent locator


def _folder(path: str) -> str:
    return path.rpartition("/")[0] or "."


def _name_version(text: str) -> tuple[str, str]:
    head, at, tail = text.strip().rpartition("@")
    return (head, tail) if at and head else (text.strip(), "")


def npm_lock(path: str, text: str) -> Iterator[Instance]:
    """Installed folders; a nested lockfile prefixes locators and parents alike."""
    prefix = "" if _folder(path) == "." else _folder(path) + "/"
    for place, entry in sorted((json.loads(text).get("packages") or {}).items()):
        name = place.rpartition("node_modules/")[2] if "node_modules/" in place else ""
        if not name or entry.get("link") or not entry.get("version"):
            continue
        parent = place.rpartition("/node_modules/")[0]
        yield prefix + place, purl("npm", name, entry["version"]), prefix + parent if parent else None


def pnpm_lock(path: str, text: str) -> Iterator[Instance]:
    doc = _dict(_yaml(text))
    for key in sorted(set(map(str, doc.get("packages") or doc.get("snapshots") or {}))):
        bare = key.lstrip("/").split("(")[0]
        name, version = _name_version(bare)
        if not version or "/" in version:
            name, _, version = bare.rpartition("/")
        if name and version:
            yield f"{_folder(path)}#{name}@{version}", purl("npm", name, version), None


def yarn_lock(path: str, text: str) -> Iterator[Instance]:
    pairs: list[tuple[str, str]] = []
    if "__metadata:" in text:
        for key, entry in _dict(_yaml(text)).items():
            name, how = _name_version(str(_dict(entry).get("resolution") or key))
            if _dict(entry).get("version") and key != "__metadata" and not how.startswith("workspace:") and "@workspace:" not in str(_dict(entry).get("resolution")):
                # protocols such as npm: stay behind the last @
                pairs.append((name.rpartition("@npm")[0] or name, str(entry["version"])))
    else:
        name = ""
        for line in text.split("\n"):
            if line and not line.startswith((" ", "#")) and line.rstrip().endswith(":"):
                name = _name_version(line.rstrip()[:-1].split(",")[0].strip().strip('"'))[0]
            m = re.match(r'^\s+version:?\s+"?([^"\s]+)"?\s*$', line)
            if name and m:
                pairs.append((name, m[1]))
                name = ""
    for name, version in dict.fromkeys(pairs):
        yield f"{_folder(path)}#{name}@{version}", purl("npm", name, version), None


def without_comments(text: str) -> str:
    """JSON of JSON with comments and trailing commas; strings are kept whole."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def bun_lock(path: str, text: str) -> Iterator[Instance]:
    for key, entry in sorted((json.loads(without_comments(text)).get("packages") or {}).items()):
        first = entry[0] if isinstance(entry, list) and entry and isinstance(entry[0], str) else ""
        name, version = _name_version(first)
        if version and not version.startswith(("workspace:", "link:", "file:")):
            yield f"{_folder(path)}#{key}", purl("npm", name, version), None


def cargo_lock(path: str, text: str) -> Iterator[Instance]:
    for p in tomllib.loads(text).get("package") or []:
        if p.get("name") and p.get("version") and p.get("source"):  # no source: a member of the workspace
            yield f"{_folder(path)}#{p['name']}@{p['version']}", purl("cargo", p["name"], p["version"]), None


def python_lock(path: str, text: str) -> Iterator[Instance]:
    for p in tomllib.loads(text).get("package") or []:
        source = _dict(p.get("source"))
        if p.get("name") and p.get("version") and not ({"virtual", "editable"} & set(source)):
            yield f"{_folder(path)}#{p['name']}", purl("pypi", p["name"], p["version"]), None


def go_build_list(path: str, text: str) -> Iterator[Instance]:
    requires, replaces = go_mod(text)
    for module, version, _ in requires:
        to = replaces.get((module, version)) or replaces.get((module, ""))
        if to and (to[0].startswith((".", "/")) or not to[1]):
            continue
        name, version = to or (module, version)
        yield f"{_folder(path)}#{module}", purl("golang", name, go_version(version)), None


def terraform_lock(path: str, text: str) -> Iterator[Instance]:
    for address, body in re.findall(r'^provider\s+"([^"]+)"\s*\{(.*?)^\}', text, flags=re.S | re.M):
        m = re.search(r'^\s*version\s*=\s*"([^"]+)"', body, flags=re.M)
        if m:
            yield f"{_folder(path)}#{address}", provider_id(address, m[1]), None


_OUT = r"(?!(?:.*/)?node_modules/)"
READERS: dict[str, tuple[str, Callable[[str, str], Iterator[Instance]]]] = {
    "package-lock": (rf"^{_OUT}(?:.*/)?package-lock\.json$", npm_lock),
    "pnpm-lock": (rf"^{_OUT}(?:.*/)?pnpm-lock\.yaml$", pnpm_lock),
    "yarn-lock": (rf"^{_OUT}(?:.*/)?yarn\.lock$", yarn_lock),
    "bun-lock": (rf"^{_OUT}(?:.*/)?bun\.lock$", bun_lock),
    "cargo-lock": (r"^(?!(?:.*/)?(?:vendor|target)/)(?:.*/)?Cargo\.lock$", cargo_lock),
    "poetry-lock": (r"^(?:.*/)?poetry\.lock$", python_lock),
    "uv-lock": (r"^(?:.*/)?uv\.lock$", python_lock),
    "go-mod": (r"^(?!(?:.*/)?(?:vendor|testdata)/)(?:.*/)?go\.mod$", go_build_list),
    "terraform-lock": (r"^(?!(?:.*/)?\.terraform/)(?:.*/)?\.terraform\.lock\.hcl$", terraform_lock),
}


def instances_of(path: str, content: bytes) -> Iterator[dict]:
    for name, (pattern, reader) in READERS.items():
        if not re.search(pattern, path):
            continue
        row = {"path": path, "reader": name, "derived_from": "lockfile", "error": None}
        try:
            found = list(reader(path, content.decode("utf-8", "replace")))
        except Exception as error:
            yield row | {"locator": None, "node_id": None, "parent_locator": None, "error": f"{name}: {error}"}
            continue
        for locator, node, parent in found:
            yield row | {"locator": locator, "node_id": node, "parent_locator": parent}


def read(files: DataFrame) -> DataFrame:
    """Instances in ``files(path, content[, run_id])``; a file that cannot be read
    gives one row with its error."""
    keyed = "run_id" in files.columns
    schema = ("run_id string, " if keyed else "") + SCHEMA
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                extra = {"run_id": rec.run_id} if keyed else {}
                rows += [r | extra for r in instances_of(rec.path, bytes(rec.content) if rec.content is not None else b"")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select(*(["run_id"] if keyed else []), "path", "content").mapInPandas(run, schema).where(F.col("locator").isNotNull() | F.col("error").isNotNull()).dropDuplicates()
