"""Package identities as native columns: minting, splitting, classifying."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package types that advisories can be looked up for.
PACKAGE_TYPES = (
    "npm", "pypi", "deb", "apk", "rpm", "cargo", "maven", "golang", "nuget", "gem", "composer", "hex", "pub", "conan",
    "cocoapods", "swift", "cran", "hackage", "terraform", "terraform-cli",
)
BUILD_FILE = "pkg:generic/buildfile/"

_PURL = r"^pkg:([^/]+)/(.*?)(?:@([^?#]*))?(?:[?#].*)?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def escape(x: Column) -> Column:
    """Percent-encode a path segment; ``:`` and ``~`` stay readable, blanks are %20."""
    out = F.url_encode(x)
    for coded, plain in (("+", "%20"), ("%3A", ":"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def unescape(x: Column) -> Column:
    """Percent-decode with a literal plus sign; text that does not decode stays."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def pypi_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[-_.]+", "-")


def purl(ecosystem: Column | str, name: Column | str, version: Column | str | None = None) -> Column:
    """Canonical package URL. Names keep their last segment apart from the
    namespace; npm scopes are namespaces; PyPI names are folded."""
    eco, name = _c(ecosystem), _c(name)
    folded = F.when(eco == "pypi", pypi_name(name)).otherwise(name)
    path = F.array_join(F.transform(F.split(folded, "/"), escape), "/")
    out = F.concat(F.lit("pkg:"), eco, F.lit("/"), path)
    if version is None:
        return out
    version = empty_as_null(_c(version))
    return F.concat(out, F.coalesce(F.concat(F.lit("@"), escape(version)), F.lit("")))


def purl_type(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), r"^(?:pkg:)?([^/]+)/", 1)


def purl_name(x: Column | str) -> Column:
    return unescape(F.regexp_extract(_c(x), _PURL, 2))


def purl_version(x: Column | str) -> Column:
    """Decoded version; empty if there is none."""
    return unescape(F.regexp_extract(_c(x), _PURL, 3))


def is_package(x: Column | str) -> Column:
    return purl_type(x).isin(*PACKAGE_TYPES)


def is_action(x: Column | str) -> Column:
    return _c(x).rlike(r"^pkg:github/[^@#?]*/")


def is_build_file(x: Column | str) -> Column:
    return _c(x).startswith(BUILD_FILE)


def action_name(x: Column | str) -> Column:
    return F.when(is_action(x), F.regexp_extract(_c(x), r"^pkg:github/([^@#?]*)", 1))


def ref_of(x: Column | str) -> Column:
    """What follows the last ``@``, up to a qualifier or subpath."""
    return F.regexp_extract(_c(x), r"@([^@#?]*)(?:[#?].*)?$", 1)


def surface_of(from_id: Column | str) -> Column:
    x = _c(from_id)
    return F.when(~is_build_file(x), "manifest").when(x.startswith(BUILD_FILE + "dockerfile@"), "dockerfile").otherwise("ci")


def advisory_key(x: Column | str) -> Column:
    """``struct<ecosystem, key>`` that advisories are filed under: actions by
    name, Terraform providers and the CLI as the Go modules they are built from,
    all else by package URL."""
    x = _c(x)
    version = F.regexp_extract(x, r"^[^@]*@([^?#]*)", 1)
    v = F.when(version == "", "").otherwise(F.concat(F.lit("@"), F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version))))
    provider = r"^pkg:terraform/([^/@?#]+)/([^/@?#]+)(?:[@?#].*)?$"
    key = (
        F.when(is_action(x), action_name(x))
        .when(x.rlike(provider), F.concat(F.lit("pkg:golang/github.com/"), F.regexp_extract(x, provider, 1), F.lit("/terraform-provider-"), F.regexp_extract(x, provider, 2), v))
        .when(x.startswith("pkg:terraform-cli/"), F.concat(F.lit("pkg:golang/github.com/hashicorp/terraform"), v))
        .otherwise(x)
    )
    return F.struct(F.when(is_action(x), "GitHub Actions").otherwise("purl").alias("ecosystem"), key.alias("key"))


def short_hash(x: Column, n: int = 12) -> Column:
    return F.substr(F.sha2(x, 256), F.lit(1), F.lit(n))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def build_file_id(kind: Column | str, path: Column | str) -> Column:
    kind, path = (F.lit(kind) if isinstance(kind, str) else kind), _c(path)
    return F.concat(F.lit(BUILD_FILE), kind, F.lit("@"), short_hash(path), F.lit("#"), path)


def parse_error_id(extractor: Column, path: Column) -> Column:
    return F.concat(F.lit("pkg:generic/unparsed/"), escape(base_name(path)), F.lit("@"), short_hash(F.concat_ws("\u0000", extractor, path)), F.lit("#"), path)


def canonical_remote(remote: Column | str) -> Column:
    """``struct<key, name>`` of a git remote: lower-cased host/path and the path
    as written, without user, port and ``.git``; null if there is no host."""
    x = F.trim(_c(remote))
    scp = r"^(?:[^@/:]+@)?([^/:@]+):(?!//)(.+)$"
    is_scp = x.rlike(scp) & ~x.contains("://")
    host = F.when(is_scp, F.regexp_extract(x, scp, 1)).otherwise(F.regexp_replace(F.try_parse_url(x, F.lit("HOST")), r":\d+$", ""))
    path = F.when(is_scp, F.regexp_extract(x, scp, 2)).otherwise(F.try_parse_url(x, F.lit("PATH")))
    path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "")
    return F.when((host != "") & (path != ""), F.struct(F.lower(F.concat_ws("/", host, path)).alias("key"), path.alias("name")))


def go_escape(module: Column) -> Column:
    """Module paths as proxies spell them: capitals become ``!`` and lower case."""
    return F.array_join(F.transform(F.split(module, ""), lambda c: F.when(c.rlike("[A-Z]"), F.concat(F.lit("!"), F.lower(c))).otherwise(c)), "")
