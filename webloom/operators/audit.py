"""Audits of a raw store and its crawl state, and the rows of an article export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import articles
from webloom.functions import urls as U
from webloom.functions.frames import safe

HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
SRC = r"""(?i)<(?:img|script|iframe|source)\s[^>]*?src\s*=\s*["']?([^"'\s>]+)"""


def ascii_html(html_b64: Column) -> Column:
    """A page's bytes as characters of Latin-1: enough for tags and URLs whatever the charset."""
    return F.decode(F.unbase64(html_b64), "ISO-8859-1")


def hrefs(html: Column, with_src: bool = False) -> Column:
    """Link targets of a page as they are written, sources of images and scripts too if wanted."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.concat(found, F.regexp_extract_all(html, F.lit(SRC), F.lit(1))) if with_src else found


def page_links(raw: DataFrame) -> DataFrame:
    """src, dst of all links in stored pages, both canonical."""
    rows = raw.where(F.length("html_b64") > 0).select("url", F.explode(hrefs(ascii_html(F.col("html_b64")))).alias("link"))
    return rows.select(U.normalized(F.col("url")).alias("src"), U.resolved(F.col("link"), F.col("url")).alias("dst")).where(F.col("dst").isNotNull())


def store_stats(first: DataFrame, all_rows: DataFrame, top: int = 30) -> DataFrame:
    """what, value, n: records by kind, status and section (the top ones), bytes, and repeated lines."""
    one = F.count(F.lit(1)).alias("n")
    by = lambda name, c: first.groupBy(c.alias("value")).agg(one).select(F.lit(name).alias("what"), "value", "n")
    section = F.regexp_extract("url", r"^https?://[^/]+/((?:(?:vi|en)/)?[^/?#]+)/", 1)
    sections = by("section", section).where("value <> ''").orderBy(F.col("n").desc(), "value").limit(top)
    totals = first.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(F.lit("bytes").alias("what"), F.lit("").alias("value"), "n")
    repeated = all_rows.agg((F.count(F.lit(1)) - F.countDistinct("url")).alias("n")).select(F.lit("repeated").alias("what"), F.lit("").alias("value"), "n")
    return by("kind", F.col("kind")).unionByName(by("status", F.col("status").cast("string"))).unionByName(sections).unionByName(totals).unionByName(repeated)


def check_done(done: DataFrame, records: DataFrame, home: str) -> DataFrame:
    """One row: URLs said to be done, those with a record, with a record but no body, truly missing (in scope), and stale records."""
    known = records.groupBy("url").agg(F.coalesce(F.max(F.length("html_b64") > 0), F.lit(False)).alias("body"))
    both = done.select("url", F.lit(True).alias("done")).distinct().join(known, "url", "full_outer")
    is_done, seen, has = F.coalesce("done", F.lit(False)), F.col("body").isNotNull(), F.coalesce("body", F.lit(False))
    return both.agg(
        F.count_if(is_done).alias("claimed"), F.count_if(is_done & seen).alias("present"), F.count_if(is_done & seen & ~has).alias("no_body"),
        F.count_if(is_done & ~seen & U.in_scope(F.col("url"), home, suffix=True)).alias("missing"), F.count_if(~is_done & seen).alias("stale"),
    )


def assets(targets: DataFrame, home: str) -> DataFrame:
    """ext, n: distinct targets at home by the extension of a document or other file."""
    rows = targets.where(U.in_family(U.hostname(F.col("url")), home) & U.path_of(F.col("url")).rlike(U.ASSET)).select("url").distinct()
    return rows.groupBy(U.extension(F.col("url")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def audit_categories(records: DataFrame, known: DataFrame) -> DataFrame:
    """category, max_page, got_pages, root_fetched, articles, missing: which numbered pages of a category were never fetched."""
    page = U.page_of(F.col("url"))
    stem = F.regexp_replace(F.coalesce(page["stem"], F.when(U.path_of(F.col("url")).endswith("/"), F.col("url")), F.regexp_extract("url", "^(.*/)", 1)), r"\?$", "")
    every = known.select("url").union(records.select("url")).distinct().select("url", stem.alias("category"), page["n"].alias("n"))
    got = records.select("url").distinct().withColumn("got", F.lit(True))
    rows = every.join(got, "url", "left").withColumn("got", F.coalesce("got", F.lit(False)))
    out = rows.groupBy("category").agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("max_page"), F.count_if(F.col("got") & F.col("n").isNotNull()).alias("got_pages"),
        F.coalesce(F.max(F.col("got") & (F.col("url") == F.col("category"))), F.lit(False)).alias("root_fetched"),
        F.count_if(F.col("got") & F.col("url").rlike(r"-\d+\.html$")).alias("articles"),
    )
    return out.withColumn("missing", F.greatest(F.col("max_page") - F.col("got_pages"), F.lit(0))).where("max_page > 0 or articles > 0")


def rebuild_state(records: DataFrame, known: DataFrame) -> DataFrame:
    """url, state: done (it has a record), alias (another URL of a done article) or frontier (known, neither)."""
    key = F.coalesce(U.dedup_key(F.col("url")), F.col("url"))
    done = records.select("url").distinct().withColumn("state", F.lit("done"))
    done_keys = done.select(key.alias("key")).distinct().withColumn("k", F.lit(True))
    rest = known.select("url").distinct().join(done.select("url"), "url", "left_anti").withColumn("key", key).join(done_keys, "key", "left")
    return done.unionByName(rest.select("url", F.when(F.col("k"), "alias").otherwise("frontier").alias("state")))


def missing_roots(records: DataFrame, frontier: DataFrame) -> DataFrame:
    """Roots of categories that fetched articles or numbered pages imply, neither fetched nor waiting."""
    page = U.page_of(F.col("url"))
    root = F.coalesce(page["stem"], F.when(U.dedup_key(F.col("url")).isNotNull(), F.regexp_extract("url", "^(.*/)", 1)))
    roots = records.select(F.regexp_replace(root, r"\?$", "").alias("url")).where(F.col("url").isNotNull()).distinct()
    return roots.join(records.select("url").distinct(), "url", "left_anti").join(frontier.select("url").distinct(), "url", "left_anti")


def verify_links(in_pages: DataFrame, listed: DataFrame) -> DataFrame:
    """url, side: links of pages that the link file lacks (missing), and listed ones that no page has (extra)."""
    a, b = in_pages.select("url").distinct(), listed.select("url").distinct()
    return a.join(b, "url", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "url", "left_anti").withColumn("side", F.lit("extra")))


def all_links(*sources: DataFrame, home: str) -> DataFrame:
    """url, kind of every known URL in the domain, once."""
    every = sources[0].select("url")
    for s in sources[1:]:
        every = every.unionByName(s.select("url"))
    return every.where(F.col("url").isNotNull() & U.in_family(U.hostname(F.col("url")), home)).distinct().select("url", U.kind_of(F.col("url")).alias("kind"))


def subdomains(targets: DataFrame, home: str) -> DataFrame:
    """host, n: how often the hosts of a domain are linked."""
    host = U.hostname(F.col("url"))
    return targets.where(U.in_family(host, home)).groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def grep(df: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle, whatever the case."""
    return df.where(F.lower(F.col(text)).contains(needle.lower()))


# ---------------------------------------------------------------- article export

ARTICLE = (
    "id string, url string, lang string, title string, section string, breadcrumb array<string>, author string, published_at string, modified_at string, summary string, content string, word_count bigint,"
    " thumbnail string, images array<string>, attachments array<string>, crawled_at string, source string"
)


def article_rows(pages: DataFrame, home: str) -> DataFrame:
    """The 17 fields of every page (columns url, norm, page; fetched_at if there is one) for CSV and JSON lines."""
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([articles.article(p, u or "", home, t) for u, p, t in zip(b["u"], b["page"], b["t"])], columns=articles.FIELDS)

    return pages.select(F.coalesce("norm", "url").alias("u"), "page", at.alias("t")).mapInPandas(safe(run), ARTICLE)


def export_rows(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """The 13 columns of the CSV: articles with their cards' views, and their thumbnails and dates where the page has none."""
    own = first_cards(cards).select(F.col("url").alias("_url"), "views", F.col("thumbnail").alias("_thumb"), F.col("date").alias("_date"))
    joined = rows.join(own, F.col("url") == F.col("_url"), "left").withColumns({"thumbnail": F.coalesce("thumbnail", "_thumb"), "published_at": F.coalesce("published_at", "_date")})
    return joined.select(*articles.CSV)


def listing_cards(pages: DataFrame) -> DataFrame:
    """page_url, pos, url, title, date, views, thumbnail of the cards on listing pages (columns url, page), each URL once a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(u, i, *c.values()) for u, p in zip(b["url"], b["page"]) for i, c in enumerate(articles.cards(p, u or ""))]
            yield pd.DataFrame(out, columns=["page_url", "pos", "url", "title", "date", "views", "thumbnail"]).astype({"views": "Int64"})

    return pages.select("url", "page").mapInPandas(safe(run), "page_url string, pos int, url string, title string, date string, views bigint, thumbnail string")


def first_cards(cards: DataFrame) -> DataFrame:
    """One card for each URL: the first by listing page and place."""
    rest = [c for c in cards.columns if c not in ("page_url", "pos", "url")]
    return cards.groupBy("url").agg(F.min_by(F.struct("page_url", "pos", *rest), F.struct("page_url", "pos")).alias("c")).select("url", "c.*")


def candidates(listed: DataFrame, seen: DataFrame, since: str, limit: int) -> DataFrame:
    """Newest first: articles of a listing once by number, without those seen with the same lastmod and those older than since."""
    rows = listed.withColumn("article_id", U.art_id(F.col("url"))).where(F.col("article_id").isNotNull())
    newest = rows.groupBy("article_id").agg(F.max(F.struct("lastmod", "url")).alias("m")).select("article_id", "m.url", "m.lastmod")
    fresh = newest.join(seen.select("article_id", "lastmod"), ["article_id", "lastmod"], "left_anti").where(F.col("lastmod") >= since)
    return fresh.orderBy(F.col("lastmod").desc(), "article_id").limit(limit)


def fill_gaps(details: DataFrame, cards: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detail rows whose empty fields are taken from the listing's cards."""
    own = cards.groupBy(key).agg(*[F.min(f).alias(f"_{f}") for f in fields])
    joined = details.join(own, key, "left")
    return joined.withColumns({f: F.coalesce(F.when(F.col(f) != "", F.col(f)), F.col(f"_{f}"), F.lit("")) for f in fields}).drop(*[f"_{f}" for f in fields])


def merge_seen(seen: DataFrame, new: DataFrame) -> DataFrame:
    """article_id, lastmod: the state of an incremental run after new rows; the latest lastmod wins."""
    return seen.select("article_id", "lastmod").unionByName(new.select("article_id", "lastmod")).groupBy("article_id").agg(F.max("lastmod").alias("lastmod"))
