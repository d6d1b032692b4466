"""URL algebra as column expressions; what needs Python's own URL rules is an Arrow UDF at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Query parameters that only track, and file extensions by kind.
TRACKING = ("fbclid", "utm_source", "utm_medium", "utm_campaign", "gidzl", "PHPSESSID")
DOCUMENT_EXT = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
IMAGE_EXT = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico")
ASSET = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|jpe?g|png|gif|svg|webp|mp4|mp3|css|js|ico)$"
# Parts of paths and queries that a crawl leaves out.
SKIP_PREFIX = ("/admin/", "/users/", "/data/", "/includes/", "/modules/", "/install/", "/statistics/", "/seek/", "/rss/", "/print/")
SKIP_SEGMENT = r"/(feeds|rss|seek|print|admin|users|statistics|shout|export)(/|$)"
SKIP_QUERY = r"(^|&)(download|submit)=1(&|$)"
# The forms of numbered listing pages, in order of precedence.
PAGE_FORMS = (
    (r"^(.*/)page-(\d+)/?$", "page-{n}/"), (r"^(.*/)trang-(\d+)/?$", "trang-{n}/"), (r"^(.*/)p(\d+)/?$", "p{n}/"),
    (r"^(.*?[?&])page=(\d+)$", "page={n}"), (r"^(.*?[?&])paged=(\d+)$", "paged={n}"), (r"^(.*/)page/(\d+)/?$", "page/{n}/"),
)
# Marks of a page that stops robots.
BLOCK_MARKS = "(?i)cf-browser-verification|just a moment|checking your browser|captcha|attention required|ddos protection"
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path without parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_query(url: Column) -> Column:
    q = query_of(url)
    return F.concat(path_of(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def after_host(url: Column) -> Column:
    """What follows the host, fragment included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def is_full_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def hostname(url: Column) -> Column:
    """Host in lower case, without user and port; brackets of an IPv6 address are taken off. '' if there is none."""
    full = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.lower(F.when(full.startswith("["), F.regexp_extract(full, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(full, r"^([^:]*)", 1)))


def normalized(url: Column) -> Column:
    """Canonical form of an absolute URL; null for what isn't http(s), for null, empty, script, mail and telephone links and fragments.

    https, lower-case host without any "www.", single slashes, no fragment, no path parameters, no tracking or empty query parts.
    """
    u = strip(url)
    names = F.filter(F.split(query_of(u), "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING))
    query = F.array_join(names, "&")
    made = F.concat(
        F.lit("https://"), F.replace(F.lower(netloc(u)), F.lit("www."), F.lit("")), F.regexp_replace(path_of(u), "//+", "/"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(u.rlike(r"(?i)^https?://[^/?#]"), made)


def dedup_key(url: Column) -> Column:
    """Last path segment of an article (…-digits.html), else null."""
    return F.when(path_of(url).rlike(r"-\d+\.html$"), F.regexp_extract(path_of(url), r"([^/]*)$", 1))


def art_id(url: Column) -> Column:
    """Trailing number of an article; it isn't unique. null if there is none."""
    found = F.regexp_extract(path_of(url), r"-(\d+)\.html$", 1)
    return F.when(found != "", found)


def page_of(url: Column) -> Column:
    """struct(template, n, stem) of a numbered listing page by the first form that fits, else null."""
    found = None
    for pattern, rest in reversed(PAGE_FORMS):
        stem = F.regexp_extract(url, pattern, 1)
        n = F.regexp_extract(url, pattern, 2).try_cast("bigint")
        made = F.struct(F.concat(stem, F.lit(rest)).alias("template"), n.alias("n"), stem.alias("stem"))
        found = F.when(url.rlike(pattern), made) if found is None else F.when(url.rlike(pattern), made).otherwise(found)
    return found


def is_listing_page(url: Column) -> Column:
    fits = F.lit(False)
    for pattern, _ in PAGE_FORMS:
        fits = fits | url.rlike(pattern)
    return fits


def kind_of(url: Column) -> Column:
    """listing-page, article, listing or other."""
    return (
        F.when(is_listing_page(url), "listing-page").when(path_of(url).rlike(r"-\d+\.html$"), "article").when(path_of(url).endswith("/"), "listing").otherwise("other")
    )


def in_family(host: Column, home: str) -> Column:
    return (host == home) | host.endswith("." + home)


def in_scope(url: Column, home: str, suffix: bool = False) -> Column:
    """Whether a crawl of home (of its subdomains too, with suffix) takes the URL."""
    host, path = hostname(url), path_of(url)
    ok = in_family(host, home) if suffix else host == home
    for p in SKIP_PREFIX:
        ok = ok & ~path.startswith(p)
    return F.coalesce(ok & ~path.rlike(ASSET) & ~path.rlike(SKIP_SEGMENT) & ~query_of(url).rlike(SKIP_QUERY), F.lit(False))


def extension(url: Column) -> Column:
    """Extension of the last path segment in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})$", 1))


def dest_kind(url: Column, home: str) -> Column:
    """external, document, image or page."""
    ext = extension(url)
    return (
        F.when(~in_family(hostname(url), home), "external")
        .when(ext.isin(*DOCUMENT_EXT) | query_of(url).contains("download=1"), "document")
        .when(ext.isin(*IMAGE_EXT), "image")
        .otherwise("page")
    )


def file_type(given: Column, kind: Column, url: Column) -> Column:
    """The given type in lower case; html for pages; the extension; khac (other)."""
    ext = extension(url)
    return F.when(F.coalesce(given, F.lit("")) != "", F.lower(given)).when(kind == "page", "html").when(ext != "", ext).otherwise("khac")


def canonical_order(url: str | None) -> tuple[float, int]:
    """Sort key: the more canonical of two URLs has fewer slashes, then fewer characters; no URL comes last."""
    return (math.inf, 0) if url is None else (url.count("/"), len(url))


def classify_content(content_type: Column, url: Column) -> Column:
    """html, document, image or other, from the declared type, else from the URL."""
    t, ext = F.lower(F.coalesce(content_type, F.lit(""))), extension(url)
    office = t.rlike("pdf|msword|officedocument|ms-excel|ms-powerpoint|openxmlformats")
    return (
        F.when(t.contains("html"), "html").when(office | ext.isin(*DOCUMENT_EXT), "document").when(t.startswith("image/") | ext.isin(*IMAGE_EXT), "image").otherwise("other")
    )


def lang_of(url: Column) -> Column:
    return F.when(path_of(url).startswith("/en/"), "en").otherwise("vi")


def looks_blocked(status: Column, html: Column) -> Column:
    """A page that a bot wall or an empty single-page shell answered."""
    body = F.coalesce(html, F.lit(""))
    words = F.size(F.filter(F.split(F.regexp_replace(body, "<[^>]+>", " "), r"\s+"), lambda w: w != ""))
    links = F.size(F.split(body, "href=")) - 1
    return F.coalesce(status, F.lit(0)).isin(403, 429, 503) | F.substring(body, 1, 20_000).rlike(BLOCK_MARKS) | ((links <= 2) & (words < 120))


# ---------------------------------------------------------------- Python's own rules


def python_norm(url: str | None, base: str) -> str | None:
    """Canonical form of an absolute or relative link; the rules are those of normalized()."""
    if not url or url.startswith("#") or url.lower().startswith(("javascript:", "mailto:", "tel:")):
        return None
    try:
        full = urljoin(base, url.strip())
        parts = urlsplit(full)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    path = parts.path
    cut = path.find(";", path.rfind("/") + 1)
    path = path if cut < 0 else path[:cut]
    while "//" in path:
        path = path.replace("//", "/")
    kept = [p for p in parts.query.split("&") if p and p.partition("=")[0] not in TRACKING]
    return f"https://{parts.netloc.lower().replace('www.', '')}{path}" + (f"?{'&'.join(kept)}" if kept else "")


@F.pandas_udf(StringType())
def resolved(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Canonical form of a link found on a page: resolved(link, base)."""
    for link, base in batches:
        yield pd.Series([python_norm(u, b or "") for u, b in zip(link, base)], dtype=object)


def http_uri(url: str | None) -> str | None:
    """A URL with what isn't allowed in a URI percent-encoded; existing escapes stay."""
    return None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")


@F.pandas_udf(StringType())
def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for urls in batches:
        yield pd.Series([http_uri(u) for u in urls], dtype=object)


@F.pandas_udf(StringType())
def unquoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for urls in batches:
        yield pd.Series([None if u is None else unquote(u) for u in urls], dtype=object)


class Rules:
    """robots.txt: groups of agents with their rules in order; the first matching line of a group decides."""

    def __init__(self, text: str):
        self.groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
        agents, rules = [], []
        for raw in text.splitlines():
            name, colon, value = raw.split("#", 1)[0].partition(":")
            name, value = name.strip().lower(), value.strip()
            if not colon:
                continue
            if name == "user-agent":
                if rules:
                    self.groups.append((agents, rules))
                    agents, rules = [], []
                agents.append(value.lower())
            elif name in ("allow", "disallow") and agents:
                if name == "disallow" and not value:
                    rules.append(("", True))
                else:
                    rules.append((quote(unquote(value), safe="/%?=&"), name == "allow"))
        if agents:
            self.groups.append((agents, rules))

    def allows(self, agent: str, url: str) -> bool:
        agent = agent.split("/")[0].lower()
        parts = urlsplit(url)
        path = quote(unquote(parts.path or "/"), safe="/%") + (f"?{parts.query}" if parts.query else "")
        chosen = next((r for names, r in self.groups if any(n != "*" and n in agent for n in names)), None)
        if chosen is None:
            chosen = next((r for names, r in self.groups if "*" in names), [])
        return next((allow for prefix, allow in chosen if path.startswith(prefix)), True)


@F.pandas_udf(BooleanType())
def can_fetch(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """can_fetch(robots text, agent, url); each text is parsed once a worker."""
    parsed: dict[str, Rules] = {}
    for texts, agents, urls in batches:
        yield pd.Series([parsed.setdefault(t or "", Rules(t or "")).allows(a, u) for t, a, u in zip(texts, agents, urls)])
