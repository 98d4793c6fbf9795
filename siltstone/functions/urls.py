"""Addresses: parsing, canonical form and allow-list rules, as native column expressions on the RFC 3986 pattern."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST = r"^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)(?::(.*))?$"
#: Reasons, in the order in which they are looked for (fixed values).
MALFORMED, HTTPS_REQUIRED, UNSUPPORTED, CREDENTIALS, INVALID_HOST, INVALID_PATH, OK = "malformed_url", "https_required", "unsupported_scheme", "credentials_rejected", "invalid_host", "invalid_path", "ok"
#: Links that are no pages, and where a library's pages lie (fixed values).
SKIPPED_SCHEMES = ("mailto:", "javascript:", "data:", "tel:")
SKIPPED_SUFFIXES = (".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js", ".woff", ".woff2", ".ico")
LIBRARY_ROOT = "/3/library"


@dataclass(frozen=True)
class Url:
    """The parts of an address column."""

    raw: Column

    @property
    def trimmed(self) -> Column:
        return F.trim(self.raw)

    def part(self, n: int) -> Column:
        return F.regexp_extract(self.trimmed, PARTS, n)

    @property
    def scheme(self) -> Column:
        return F.lower(self.part(1))

    @property
    def authority(self) -> Column:
        return self.part(2)

    @property
    def host(self) -> Column:
        return F.lower(F.regexp_extract(self.authority, HOST, 1))

    @property
    def port(self) -> Column:
        return F.regexp_extract(self.authority, HOST, 2)

    @property
    def port_ok(self) -> Column:
        """No port, or a number up to 65535."""
        return (self.port == "") | (F.coalesce(F.when(self.port.rlike("^[0-9]{1,5}$"), self.port.cast("int")), F.lit(65536)) <= 65535)

    @property
    def path(self) -> Column:
        """Without the parameters of the last segment, runs of slashes made one, no slash at the end but for the root."""
        path = F.regexp_replace(F.regexp_replace(self.part(3), r";[^/]*$", ""), "/{2,}", "/")
        return F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))

    def canonical(self, keep_query: Column | None = None) -> Column:
        """Lower-case scheme and host, no credentials, no default port, no fragment, no query unless kept; null where scheme, host or port are unusable."""
        default = F.when(self.scheme == "https", "443").when(self.scheme == "http", "80").otherwise("")
        port = F.when((self.port == "") | (F.regexp_replace(self.port, "^0+", "") == default), "").otherwise(F.concat(F.lit(":"), F.regexp_replace(self.port, "^0+(?=[0-9])", "")))
        query = F.lit("")
        if keep_query is not None:
            query = F.when(F.coalesce(keep_query, F.lit(False)) & (self.part(4) != ""), F.concat(F.lit("?"), self.part(4))).otherwise("")
        return F.when((self.scheme != "") & (self.host != "") & self.port_ok, F.concat(self.scheme, F.lit("://"), self.host, port, self.path, query))


def canonical_url(url: Column, keep_query: Column | None = None) -> Column:
    """The canonical form of an address."""
    return Url(url).canonical(keep_query)


def path_allowed(path: Column, prefixes: Column, exact: Column | None = None, stems: Column | None = None) -> Column:
    """A path is allowed if it is listed, equals a prefix or lies below one ('/a' does not allow '/ab'), or belongs to a library stem."""
    allowed = F.exists(prefixes, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))
    if exact is not None:
        allowed = allowed | F.array_contains(exact, path)
    if stems is not None:
        allowed = allowed | library_path(path, stems)
    return F.coalesce(allowed, F.lit(False))


def library_path(path: Column, stems: Column) -> Column:
    """The library's root or index, or one page right below it that is named by a stem, by itself or before '-' or '.'."""
    rest = F.regexp_extract(path, f"^{LIBRARY_ROOT}/([^/]+)$", 1)
    name = F.regexp_replace(rest, r"\.html$", "")
    named = F.exists(stems, lambda s: (name == s) | name.startswith(F.concat(s, F.lit("-"))) | name.startswith(F.concat(s, F.lit("."))))
    return (path == LIBRARY_ROOT) | ((rest != "") & (name.isin("", "index") | named))


def _before_host(url: Url) -> Column:
    """The reasons that need no registry; null where none applies."""
    return (
        F.when(url.raw.isNull() | (url.trimmed == "") | (url.scheme == ""), MALFORMED)
        .when(url.scheme == "http", HTTPS_REQUIRED)
        .when(url.scheme != "https", UNSUPPORTED)
        .when(url.authority.contains("@"), CREDENTIALS)
        .when((url.host == "") | ~url.port_ok, MALFORMED)
    )


def url_reason(raw: Column, hosts: Column, prefixes: Column, exact: Column | None = None, stems: Column | None = None) -> Column:
    """The first reason against an address, or 'ok'."""
    url = Url(raw)
    return F.coalesce(_before_host(url), F.when(~F.coalesce(F.array_contains(hosts, url.host), F.lit(False)), INVALID_HOST).when(~path_allowed(url.path, prefixes, exact, stems), INVALID_PATH).otherwise(OK))


def sitemap_reason(raw: Column, hosts: Column, sitemaps: Column, allow_child: Column) -> Column:
    """Like url_reason for sitemaps: a listed one, or a child ('.xml' or 'sitemap' in the path) where children are allowed."""
    url = Url(raw)
    listed = F.coalesce(F.array_contains(F.transform(sitemaps, lambda s: Url(s).canonical()), url.canonical()), F.lit(False))
    child = allow_child & (url.path.endswith(".xml") | F.lower(url.path).contains("sitemap"))
    return F.coalesce(_before_host(url), F.when(~F.coalesce(F.array_contains(hosts, url.host), F.lit(False)), INVALID_HOST).when(listed | child, OK).otherwise(INVALID_PATH))


def robots_reason(raw: Column, hosts: Column) -> Column:
    """Only '/robots.txt' on a registered host."""
    url = Url(raw)
    return F.coalesce(_before_host(url), F.when(~F.coalesce(F.array_contains(hosts, url.host), F.lit(False)), INVALID_HOST).when(url.path != "/robots.txt", "invalid_robots_path").otherwise(OK))


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, target: pd.Series) -> pd.Series:
    """The absolute form of a target (a link or a redirect's location) found at base; null for a blank target."""

    def one(b: str | None, t: str | None) -> str | None:
        if t is None or not t.strip():
            return None
        try:
            return urljoin(b or "", t.strip())
        except ValueError:
            return None

    return pd.Series([one(b, t) for b, t in zip(base, target)], dtype=object)


def link_kept(href: Column, absolute: Column) -> Column:
    """Links to follow: not empty, no fragment alone, none of the skipped schemes and file types."""
    low = F.lower(F.trim(href))
    path = F.lower(F.regexp_extract(absolute, r"^([^?#]*)", 1))
    kept = (low != "") & ~low.startswith("#")
    for s in SKIPPED_SCHEMES:
        kept = kept & ~low.startswith(s)
    for s in SKIPPED_SUFFIXES:
        kept = kept & ~path.endswith(s)
    return F.coalesce(kept, F.lit(False))
