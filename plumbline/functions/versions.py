"""Version algebra: orderable keys, compiled ranges, native evaluation.

A version becomes a *key*: a string whose byte order is the version order of
its scheme, so ORDER BY, max_by, range joins and comparisons need no function
of their own. Keys of version columns are built from native expressions.

A range becomes a *compiled spec*: alternatives, each a list of key intervals
(possibly negated) with its rule for pre-releases. Ranges have irregular
grammars and few distinct values, so distinct specs are compiled once in an
Arrow-batched function; testing a version against a compiled spec is native.

Schemes: npm, cargo, golang, terraform (semantic versions) and pypi (PEP 440);
poetry() translates its dialect to PEP 440.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPEC_TYPE = (
    "struct<ok boolean, exact boolean, mentions_pre boolean, alternatives array<struct<"
    "terms array<struct<lo string, lo_in boolean, hi string, hi_in boolean, negated boolean>>,"
    "pre string, triples array<string>, literal string, no_post array<string>>>>"
)

# --- keys -----------------------------------------------------------------


def _number(x: int | str) -> str:
    digits = str(int(x))
    return f"{len(digits):03d}{digits}"


def _number_col(x: Column) -> Column:
    digits = F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(digits).cast("string"), 3, "0"), digits)


_SEMVER = {
    "npm": r"^\s*v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?\s*$",
    "cargo": r"^\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?\s*$",
    "golang": r"^\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?\s*$",
    "terraform": r"^\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?\s*$",
}
_PEP440 = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"(?:(?:-(\d+))|(?:[-_.]?(post|rev|r)[-_.]?(\d+)?))?(?:[-_.]?(dev)[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_PHASE = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "c", "rc": "c", "pre": "c", "preview": "c"}


def _identifiers(pre: str) -> str:
    return " ".join("0" + _number(p) if p.isdigit() else "1" + p for p in pre.split("."))


@dataclass
class Semver:
    nums: tuple[int, int, int]
    pre: str = ""

    @property
    def triple(self) -> str:
        return ".".join(map(_number, self.nums))

    @property
    def key(self) -> str:
        return self.triple + ("-" + _identifiers(self.pre) if self.pre else "~")

    @property
    def floor(self) -> str:
        """Below every pre-release of these numbers but the lowest one, 0."""
        return self.triple + "-" + _identifiers("0")


@dataclass
class Pep440:
    epoch: int
    release: tuple[int, ...]
    pre: tuple[str, int] | None = None
    post: int | None = None
    dev: int | None = None

    @property
    def base(self) -> str:
        parts = list(self.release)
        while parts and parts[-1] == 0:
            parts.pop()
        return _number(self.epoch) + "!" + "".join("." + _number(p) for p in parts) + " "

    @property
    def key(self) -> str:
        if self.pre:
            phase = "1" + self.pre[0] + _number(self.pre[1])
        else:
            phase = "0" if self.post is None and self.dev is not None else "2"
        post = "0" if self.post is None else "1" + _number(self.post)
        dev = "1" if self.dev is None else "0" + _number(self.dev)
        return self.base + phase + post + dev

    @property
    def is_pre(self) -> bool:
        return self.pre is not None or self.dev is not None


def parse_semver(scheme: str, text: str) -> Semver | None:
    m = re.match(_SEMVER[scheme], text)
    return Semver((int(m[1]), int(m[2] or 0), int(m[3] or 0)), m[4] or "") if m else None


def parse_pep440(text: str) -> Pep440 | None:
    m = re.match(_PEP440, text.lower())
    if not m:
        return None
    return Pep440(
        int(m[1] or 0),
        tuple(int(p) for p in m[2].split(".")),
        (_PHASE[m[3]], int(m[4] or 0)) if m[3] else None,
        int(m[5]) if m[5] else int(m[7] or 0) if m[6] else None,
        int(m[9] or 0) if m[8] else None,
    )


def _group(x: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, n), F.lit(""))


def semver_columns(version: Column, scheme: str) -> Column:
    """``struct<key, triple, is_pre, canonical>``; null if it is not a version."""
    pattern = _SEMVER[scheme]
    part = [F.coalesce(_group(version, pattern, i), F.lit("0")) for i in (1, 2, 3)]
    triple = F.concat_ws(".", *[_number_col(p) for p in part])
    pre = _group(version, pattern, 4)
    ids = F.array_join(
        F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), _number_col(p))).otherwise(F.concat(F.lit("1"), p))), " "
    )
    plain = F.concat_ws(".", *[F.regexp_replace(p, r"^0+(?=\d)", "") for p in part])
    canonical = F.concat(F.lit("v" if scheme == "golang" else ""), plain, F.coalesce(F.concat(F.lit("-"), pre), F.lit("")))
    return F.when(
        version.rlike(pattern),
        F.struct(
            F.concat(triple, F.coalesce(F.concat(F.lit("-"), ids), F.lit("~"))).alias("key"),
            triple.alias("triple"),
            pre.isNotNull().alias("is_pre"),
            canonical.alias("canonical"),
        ),
    )


def pep440_columns(version: Column) -> Column:
    """``struct<key, triple, is_pre, canonical>``; ``triple`` is the release key
    of a post-release, else null."""
    x = F.lower(version)
    g = lambda n: _group(x, _PEP440, n)
    num = lambda c: F.coalesce(c, F.lit("0"))
    release = F.regexp_replace(g(2), r"(\.0+)+$", "")
    parts = F.transform(F.split(release, r"\."), lambda p: F.concat(F.lit("."), _number_col(p)))
    parts = F.when(release.rlike(r"^0+$"), F.array().cast("array<string>")).otherwise(parts)
    base = F.concat(_number_col(num(g(1))), F.lit("!"), F.array_join(parts, ""), F.lit(" "))
    tag = F.when(g(3).isin("a", "alpha"), "a").when(g(3).isin("b", "beta"), "b").otherwise("c")
    post = F.coalesce(g(5), F.when(g(6).isNotNull(), num(g(7))))
    dev = F.when(g(8).isNotNull(), num(g(9)))
    phase = F.when(g(3).isNotNull(), F.concat(F.lit("1"), tag, _number_col(num(g(4))))).when(post.isNull() & dev.isNotNull(), "0").otherwise("2")
    key = F.concat(
        base,
        phase,
        F.coalesce(F.concat(F.lit("1"), _number_col(post)), F.lit("0")),
        F.coalesce(F.concat(F.lit("0"), _number_col(dev)), F.lit("1")),
    )
    plain = lambda c: F.regexp_replace(c, r"^0+(?=\d)", "")
    short = F.when(tag == "c", "rc").otherwise(tag)
    canonical = F.concat(
        F.when(plain(num(g(1))) == "0", "").otherwise(F.concat(plain(num(g(1))), F.lit("!"))),
        F.array_join(F.transform(F.split(g(2), r"\."), plain), "."),
        F.when(g(3).isNotNull(), F.concat(short, plain(num(g(4))))).otherwise(""),
        F.coalesce(F.concat(F.lit(".post"), plain(post)), F.lit("")),
        F.coalesce(F.concat(F.lit(".dev"), plain(dev)), F.lit("")),
        F.coalesce(F.concat(F.lit("+"), g(10)), F.lit("")),
    )
    return F.when(
        x.rlike(_PEP440),
        F.struct(key.alias("key"), F.when(post.isNotNull(), base).alias("triple"), (g(3).isNotNull() | dev.isNotNull()).alias("is_pre"), canonical.alias("canonical")),
    )


def version_columns(ecosystem: Column, version: Column) -> Column:
    """Parsed version for any ecosystem; null where there is no scheme."""
    out = F.when(ecosystem == "pypi", pep440_columns(version))
    for scheme in _SEMVER:
        out = out.when(ecosystem == scheme, semver_columns(version, scheme))
    return out.when(ecosystem == "terraform-cli", semver_columns(version, "terraform"))


# --- release arithmetic ----------------------------------------------------


@dataclass
class Release:
    """Three numbers, and how many components were written."""

    nums: tuple[int, int, int]
    given: int

    @classmethod
    def parse(cls, text: str) -> Release:
        base = re.split(r"[-+]", text.strip().removeprefix("v"), maxsplit=1)[0]
        parts = base.split(".")
        nums = [int(p) for p in parts[:3]]
        return cls(tuple(nums + [0] * (3 - len(nums))), len(parts))

    def caret_upper(self) -> tuple[int, int, int]:
        lead = next((i for i, n in enumerate(self.nums) if n), min(self.given, 3) - 1)
        return tuple(self.nums[lead] + 1 if i == lead else 0 for i in range(3))

    def tilde_upper(self) -> tuple[int, int, int]:
        a, b, _ = self.nums
        return (a + 1, 0, 0) if self.given == 1 else (a, b + 1, 0)

    def pessimistic_upper(self) -> tuple[int, int, int]:
        a, b, _ = self.nums
        return (a + 1, 0, 0) if self.given <= 2 else (a, b + 1, 0)


# --- compiling ranges --------------------------------------------------------


@dataclass
class Alternative:
    terms: list[dict] = field(default_factory=list)
    pre: str = "any"  # any, none, or triples: only beside a pre-release of the same numbers
    triples: list[str] = field(default_factory=list)
    literal: str | None = None
    no_post: list[str] = field(default_factory=list)

    def within(self, lo=None, lo_in=True, hi=None, hi_in=False, negated=False) -> Alternative:
        self.terms.append({"lo": lo, "lo_in": lo_in, "hi": hi, "hi_in": hi_in, "negated": negated})
        return self


def _spec(alternatives: list[Alternative], exact: bool, mentions_pre: bool = False) -> dict:
    return {"ok": True, "exact": exact, "mentions_pre": mentions_pre, "alternatives": [vars(a) for a in alternatives]}


BAD = {"ok": False, "exact": False, "mentions_pre": False, "alternatives": []}


class _Partial:
    """An npm version with missing or wild components: ``nums`` of what is given."""

    def __init__(self, text: str):
        text = re.sub(r"^[vV](?=.)", "", text.strip()).split("+")[0]
        head, dash, self.pre = text.partition("-")
        if not head and dash:
            raise ValueError(text)
        self.nums: list[int] = []
        for part in head.split(".")[:3]:
            if part in ("", "x", "X", "*"):
                break
            self.nums.append(int(part))
        for part in head.split(".")[:3]:
            if part not in ("", "x", "X", "*"):
                int(part)
        if len(self.nums) < 3:
            self.pre = ""

    def low(self) -> Semver:
        return Semver(tuple(self.nums + [0] * (3 - len(self.nums))), self.pre)

    def after(self) -> Semver:
        """The first numbers beyond everything the given components cover."""
        nums = [*self.nums[:-1], self.nums[-1] + 1]
        return Semver(tuple(nums + [0] * (3 - len(nums))))


def _npm_set(text: str) -> tuple[Alternative, bool]:
    out, exact, n = Alternative(pre="triples"), False, 0

    def bound(lo: Semver | None = None, lo_in=True, hi: Semver | None = None, hi_in=False, floor=False):
        """floor: the upper end lies below the pre-releases of ``hi``."""
        for v in (lo, hi):
            if v is not None and v.pre:
                out.triples.append(v.triple)
        if floor:
            out.triples.append(hi.triple)
        out.within(lo.key if lo else None, lo_in, (hi.floor if floor else hi.key) if hi else None, hi_in)

    hyphen = re.match(r"^\s*([0-9A-Za-z.+*-]+)\s+-\s+([0-9A-Za-z.+*-]+)\s*$", text)
    if hyphen:
        a, b = _Partial(hyphen[1]), _Partial(hyphen[2])
        if a.nums:
            bound(lo=a.low())
        if len(b.nums) == 3:
            bound(hi=b.low(), hi_in=True)
        elif b.nums:
            bound(hi=b.after(), floor=True)
        return out, False
    for token in re.sub(r"(\^|~>|~|<=|>=|<|>|=)\s+", r"\1", text.strip()).split():
        op, rest = re.match(r"^(\^|~>|~|<=|>=|<|>|=)?\s*(.*)$", token).groups()
        p = _Partial(rest)
        n += 1
        if not p.nums:
            if op in ("<", ">"):
                bound(hi=Semver((0, 0, 0)), floor=True)
            continue
        full = len(p.nums) == 3
        if op == "^":
            keep = next((i for i, x in enumerate(p.nums) if x), len(p.nums) - 1)
            if len(p.nums) == 1:
                keep = 0
            q = _Partial(".".join(map(str, p.nums[: keep + 1])))
            bound(lo=p.low(), hi=q.after(), floor=True)
        elif op in ("~", "~>"):
            q = _Partial(".".join(map(str, p.nums[:2])))
            bound(lo=p.low(), hi=q.after(), floor=True)
        elif op == ">":
            bound(lo=p.low() if full else p.after(), lo_in=not full)
        elif op == ">=":
            bound(lo=p.low())
        elif op == "<":
            bound(hi=p.low(), floor=not full)
        elif op == "<=":
            bound(hi=p.low() if full else p.after(), hi_in=full, floor=not full)
        elif full:
            exact = True
            bound(lo=p.low(), hi=p.low(), hi_in=True)
        else:
            bound(lo=p.low(), hi=p.after(), floor=True)
    return out, exact and n == 1


def compile_npm(spec: str) -> dict:
    sets = [_npm_set(part) for part in spec.split("||")]
    return _spec([a for a, _ in sets], len(sets) == 1 and sets[0][1])


def compile_pep440(spec: str) -> dict:
    out, exact, n, mentions = Alternative(), False, 0, False
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.match(r"^(===|==|!=|<=|>=|~=|<|>)\s*(.*)$", part)
        if not m:
            raise ValueError(part)
        op, rest, n = m[1], m[2].strip(), n + 1
        if op == "===":
            out.literal = rest if out.literal in (None, rest) else "\0"
            exact = True
            continue
        wild = rest.endswith(".*")
        v = parse_pep440(rest.removesuffix(".*"))
        if v is None:
            raise ValueError(part)
        mentions |= v.is_pre
        family = v.release[:-1] if op == "~=" and len(v.release) > 1 else v.release
        start = Pep440(v.epoch, family).base
        end = Pep440(v.epoch, (*family[:-1], family[-1] + 1)).base
        if op in ("==", "!=") and wild:
            out.within(start, True, end, False, op == "!=")
        elif op in ("==", "!="):
            out.within(v.key, True, v.key, True, op == "!=")
            exact |= op == "=="
        elif op == "<=":
            out.within(hi=v.key, hi_in=True)
        elif op == ">=":
            out.within(lo=v.key)
        elif op == "<":
            # a release excludes its own pre-releases, a post-release its own dev-releases
            out.within(hi=v.key if v.is_pre else v.base if v.post is None else v.key[:-1])
        elif op == ">":
            out.within(lo=v.key, lo_in=False)
            if v.post is None and not v.is_pre:
                out.no_post.append(v.base)
        else:
            out.within(v.key, True, end, False)
    return _spec([out], exact and n == 1, mentions)


def _upto(lo: str, upper: tuple[int, int, int], parse) -> dict:
    return {"lo": parse(lo).key, "hi": Semver(upper).key}


def leading_numbers(text: str) -> str:
    """The dotted components before the first wildcard."""
    kept = []
    for c in text.strip().split("."):
        if c in ("", "*", "x", "X"):
            break
        kept.append(c)
    return ".".join(kept)


def compile_cargo(spec: str) -> dict:
    out, mentions = Alternative(), False
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    for part in parts:
        op, rest = re.match(r"^(>=|<=|>|<|=|~|\^)?\s*(.*)$", part).groups()
        if not op and part == "*":
            continue
        if not op and re.search(r"[*xX]", part):
            rest = leading_numbers(part)
            if not rest:
                continue
            op = "~"
        v = parse_semver("cargo", rest)
        if v is None:
            raise ValueError(part)
        mentions |= bool(v.pre)
        if op in (None, "^"):
            out.within(v.key, True, Semver(Release.parse(rest).caret_upper()).key)
        elif op == "~":
            out.within(v.key, True, Semver(Release.parse(rest).tilde_upper()).key)
        elif op == "=":
            out.within(v.key, True, v.key, True)
        elif op[0] == ">":
            out.within(v.key, op == ">=")
        else:
            out.within(hi=v.key, hi_in=op == "<=")
    out.pre = "any" if mentions else "none"
    stripped = spec.strip()
    exact = stripped.startswith("=") and parse_semver("cargo", stripped[1:].strip()) is not None
    return _spec([out], exact, mentions)


def compile_go(spec: str) -> dict:
    """A requirement is a lower bound; build metadata is not part of identity."""
    text = spec.strip()
    v = parse_semver("golang", re.sub(r"^>=?\s*", "", text))
    if v is None:
        raise ValueError(spec)
    return _spec([Alternative().within(lo=v.key)], not re.search(r"[<>=!*,| ]", text), bool(v.pre))


def compile_terraform(spec: str) -> dict:
    out = Alternative()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        op, rest = re.match(r"^(~>|>=|<=|!=|>|<|=)?\s*(.+)$", part).groups()
        v = parse_semver("terraform", rest)
        if v is None:
            raise ValueError(part)
        if op in (None, "=", "!="):
            out.within(v.key, True, v.key, True, op == "!=")
        elif op == "~>":
            out.within(v.key, True, Semver(Release.parse(rest).pessimistic_upper()).key)
        elif op[0] == ">":
            out.within(v.key, op == ">=")
        else:
            out.within(hi=v.key, hi_in=op == "<=")
    bare = spec.strip().removeprefix("=").strip()
    exact = bool(bare) and not re.search(r"[,<>~!*]", bare) and parse_semver("terraform", bare) is not None
    return _spec([out], exact)


def poetry_to_pep440(spec: str) -> str | None:
    """Poetry's dialect as PEP 440; null for alternations and what has no bounds."""
    if spec is None or "||" in spec or "|" in spec:
        return None
    out = []
    try:
        for chunk in spec.split(","):
            for term in re.findall(r"[~^><=!]*\s*[0-9][0-9A-Za-z.*+!-]*", chunk):
                op, rest = re.match(r"^(~=|\^|~|>=|<=|==|!=|>|<)?\s*(.*)$", term.strip()).groups()
                if op == "^":
                    out += [f">={rest}", "<" + ".".join(map(str, Release.parse(rest).caret_upper()))]
                elif op == "~":
                    out += [f">={rest}", "<" + ".".join(map(str, Release.parse(rest).tilde_upper()))]
                elif op == "~=":
                    out.append(term.strip())
                elif op:
                    out.append(op + rest)
                elif re.search(r"[*xX]", rest):
                    kept = leading_numbers(rest)
                    if kept:
                        out += [f">={kept}", "<" + ".".join(map(str, Release.parse(kept).tilde_upper()))]
                else:
                    out.append(f"=={rest}")
    except ValueError:
        return None
    return ",".join(out)


COMPILERS = {"npm": compile_npm, "pypi": compile_pep440, "cargo": compile_cargo, "golang": compile_go, "terraform": compile_terraform, "terraform-cli": compile_terraform}


def compile_spec(ecosystem: str | None, spec: str | None) -> dict | None:
    """A compiled range; null without a scheme, ``ok`` false if it cannot be read."""
    compiler = COMPILERS.get(ecosystem or "")
    if compiler is None:
        return None
    try:
        return compiler(spec or "")
    except (ValueError, AttributeError):
        return dict(BAD)


def _compile(ecosystem: pd.Series, spec: pd.Series) -> pd.DataFrame:
    rows = [compile_spec(e, s) or dict(BAD) for e, s in zip(ecosystem, spec)]
    return pd.DataFrame(rows, columns=["ok", "exact", "mentions_pre", "alternatives"])


def _poetry(spec: pd.Series) -> pd.Series:
    return spec.map(poetry_to_pep440)


def with_compiled(df: DataFrame, ecosystem: str = "ecosystem", spec: str = "spec", out: str = "compiled") -> DataFrame:
    """Adds compiled specs, compiling each distinct (ecosystem, spec) once."""
    pairs = df.select(F.col(ecosystem).alias("__e"), F.col(spec).alias("__s")).distinct()
    compiled = pairs.where(F.col("__e").isin(*COMPILERS)).select("__e", "__s", F.pandas_udf(_compile, SPEC_TYPE)("__e", "__s").alias(out))
    return df.join(compiled, F.col(ecosystem).eqNullSafe(F.col("__e")) & F.col(spec).eqNullSafe(F.col("__s")), "left").drop("__e", "__s")


def poetry_translated(df: DataFrame, spec: str = "spec", out: str = "pep440") -> DataFrame:
    """Adds the PEP 440 form of Poetry constraints, each distinct one once."""
    pairs = df.select(F.col(spec).alias("__s")).distinct().withColumn(out, F.pandas_udf(_poetry, "string")("__s"))
    return df.join(pairs, F.col(spec).eqNullSafe(F.col("__s")), "left").drop("__s")


def satisfies(parsed: Column, compiled: Column) -> Column:
    """Native test of a parsed version against a compiled spec; null if either
    could not be read."""

    def term(t: Column) -> Column:
        low = t["lo"].isNull() | (parsed["key"] > t["lo"]) | (t["lo_in"] & (parsed["key"] == t["lo"]))
        high = t["hi"].isNull() | (parsed["key"] < t["hi"]) | (t["hi_in"] & (parsed["key"] == t["hi"]))
        return (low & high) != t["negated"]

    def alternative(a: Column) -> Column:
        pre = ~parsed["is_pre"] | (a["pre"] == "any") | ((a["pre"] == "triples") & F.coalesce(F.array_contains(a["triples"], parsed["triple"]), F.lit(False)))
        literal = a["literal"].isNull() | (a["literal"] == parsed["canonical"])
        post = parsed["triple"].isNull() | ~F.coalesce(F.array_contains(a["no_post"], parsed["triple"]), F.lit(False))
        return F.forall(a["terms"], term) & pre & literal & post

    return F.when(compiled["ok"] & parsed.isNotNull(), F.exists(compiled["alternatives"], alternative))


def is_exact(compiled: Column) -> Column:
    return F.coalesce(compiled["ok"] & compiled["exact"], F.lit(False))
