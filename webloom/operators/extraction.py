"""Pages to records: templates per host, extraction, edges, in Arrow batches. Pages are decoded once."""

from __future__ import annotations

import base64
import binascii
import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions.frames import safe
from webloom.functions.hosts import url_host
from webloom.functions.urls import normalized
from webloom.plans.session import materialize, spread

EDGE = "array<struct<dst: string, type: string, text: string, dst_kind: string, count: int>>"
EXTRACTION = (
    "title string, title_src string, published_at string, published_at_src string, author string, author_src string, cited_source string, section string, text string, html string,"
    f" word_count int, block_path string, block_score double, block_method string, content_edges {EDGE}, nav_edges {EDGE}"
)
#: A fingerprint is a template of its host when more than RATIO of at least LEAST_PAGES pages hold it; a table of templates
#: keeps those that at least KEEP_PAGES pages and KEEP_RATIO of them hold.
RATIO, LEAST_PAGES, KEEP_RATIO, KEEP_PAGES = 0.30, 20, 0.05, 3
#: Ids of repeated records that are sent to all executors, 8 bytes each; beyond it they are joined.
LATER = 2_000_000
#: So many templates of all hosts are held by every worker; beyond it they are joined.
HELD = 500_000


def decode_html(html_b64: str | None, encoding: str | None, status: int | None) -> str | None:
    """Text of a stored page: None without a body or from status 400 on; an unknown charset falls back to UTF-8."""
    if not html_b64 or (status is not None and status >= 400):
        return None
    try:
        raw = base64.b64decode(html_b64)
    except (binascii.Error, ValueError):
        return None
    try:
        name = codecs.lookup(encoding or "utf-8").name
        return raw.decode(name, "replace")
    except (LookupError, ValueError, AttributeError):
        return raw.decode("utf-8", "replace")


def first_per_url(raw: DataFrame) -> DataFrame:
    """The first record of each raw URL in the order of stores, shards and lines.

    Only URLs and ids are shuffled: the ids of later records are known from them, and up to LATER of them the pages are filtered where
    they are read; beyond that pages meet them in a join.
    """
    rows = raw.select("url", "rec_id", F.struct("store", "shard", "line_no", "rec_id").alias("o"))
    first = rows.groupBy("url").agg(F.min("o").alias("first")).withColumnRenamed("url", "same")
    later = materialize(rows.join(first, F.col("url").eqNullSafe(F.col("same"))).where(F.col("o") > F.col("first")).select("rec_id"))
    return spread(raw).join(F.broadcast(later) if later.count() <= LATER else later, "rec_id", "left_anti")


def decoded(raw: DataFrame) -> DataFrame:
    """rec_id, url, norm, host, page of the records with a readable body."""
    rows = raw.where(F.coalesce("status", F.lit(200)) < 400).where(F.length("html_b64") > 0).select("rec_id", "url", "html_b64", "encoding", "status")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = [decode_html(h, e, s) for h, e, s in zip(b["html_b64"], b["encoding"], b["status"])]
            yield pd.DataFrame({"rec_id": b["rec_id"], "url": b["url"], "page": pages})

    out = spread(rows).mapInPandas(safe(run), "rec_id bigint, url string, page string").where(F.col("page").isNotNull())
    norm = normalized(F.col("url"))
    return out.select("rec_id", "url", norm.alias("norm"), url_host(norm).alias("host"), "page")


def fingerprinted(pages: DataFrame) -> DataFrame:
    """Decoded pages with fps, the distinct leaf blocks of each before anything is removed. Write it once: templates read the narrow
    columns, the extraction reads the pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fps"] = [dom.page_fingerprints(dom.parse(p)) for p in b["page"]]
            yield b

    return pages.select("rec_id", "url", "norm", "host", "page").mapInPandas(safe(run), "rec_id bigint, url string, norm string, host string, page string, fps array<string>")


def page_fingerprints(pages: DataFrame) -> DataFrame:
    """norm, host, fp: the distinct leaf blocks of every page; of records with one URL the first counts."""
    rows = pages if "fps" in pages.columns else fingerprinted(pages)
    once = rows.groupBy("norm").agg(F.min("rec_id").alias("rec_id"))
    return rows.join(once.select("rec_id"), "rec_id", "left_semi").select("norm", "host", F.explode_outer("fps").alias("fp"))


def template_table(prints: DataFrame, keep_ratio: float = KEEP_RATIO, keep_pages: int = KEEP_PAGES) -> DataFrame:
    """host, n_pages, fp, n: on how many pages of its host a fingerprint stands, for those on enough of them."""
    pages = prints.groupBy("host").agg(F.countDistinct("norm").alias("n_pages"))
    n = prints.where(F.col("fp").isNotNull()).groupBy("host", "fp").agg(F.count(F.lit(1)).alias("n"))
    return n.join(pages, "host").where(F.col("n") >= F.greatest(F.lit(float(keep_pages)), F.col("n_pages") * keep_ratio)).select("host", "n_pages", "fp", "n")


def active_templates(templates: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, fp of the templates that are removed."""
    return templates.where((F.col("n_pages") >= least_pages) & (F.col("n") > ratio * F.col("n_pages"))).select("host", "fp")


def template_source(rows: DataFrame, templates: DataFrame | None) -> tuple[DataFrame, Callable[[pd.DataFrame], list[frozenset[str]]]]:
    """(rows, known): known(batch) gives the templates of each row's host.

    Workers hold all hosts' templates up to HELD of them; beyond that they come to each row by a join on its host, where one host
    has at most as many as 1 / RATIO pages hold.
    """
    none: frozenset[str] = frozenset()
    if templates is None:
        return rows, lambda b: [none] * len(b)
    templates = materialize(templates)
    if templates.count() <= HELD:
        sets: dict[str, set[str]] = {}
        for r in templates.toLocalIterator():
            sets.setdefault(r["host"], set()).add(r["fp"])
        held = rows.sparkSession.sparkContext.broadcast({h: frozenset(v) for h, v in sets.items()})
        return rows, lambda b: [held.value.get(h, none) for h in b["host"]]
    own = templates.groupBy("host").agg(F.collect_set("fp").alias("fps"))
    return rows.join(own, "host", "left"), lambda b: [none if f is None else frozenset(f) for f in b["fps"]]


def extract_pages(pages: DataFrame, home: str, templates: DataFrame | None = None, selectors: dict[str, str] | None = None) -> DataFrame:
    """rec_id, url, norm, host and the extraction of every page that has a title or a text."""
    rows, known = template_source(pages.select("rec_id", "url", "norm", "host", "page"), templates)
    chosen = selectors or {}
    names = [f.strip().split(" ")[0] for f in EXTRACTION.replace(EDGE, "edges").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec, url, norm, host, page, fps in zip(b["rec_id"], b["url"], b["norm"], b["host"], b["page"], known(b)):
                found = dom.extract(page, norm or url, fps, home, chosen.get(host))
                if found:
                    out.append((rec, url, norm, host, *(found[n] for n in names)))
            yield pd.DataFrame(out, columns=["rec_id", "url", "norm", "host", *names])

    return rows.mapInPandas(safe(run), f"rec_id bigint, url string, norm string, host string, {EXTRACTION}")


def explain_pages(pages: DataFrame, home: str, templates: DataFrame | None = None) -> DataFrame:
    """rec_id, characters after each layer, the steps of the descent and the numbers of edges: how a block was chosen."""
    step = "array<struct<parent: string, parent_score: double, threshold: double, stop: boolean, rest: int, candidates: array<struct<label: string, chars: int, link_chars: int, paragraphs: int, weight: double, score: double, winner: boolean>>>>"
    rows, known = template_source(pages.select("rec_id", "url", "norm", "host", "page"), templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec, url, norm, page, fps in zip(b["rec_id"], b["url"], b["norm"], b["page"], known(b)):
                trace: dict = {}
                found = dom.extract(page, norm or url, fps, home, trace=trace)
                if found:
                    out.append((rec, trace["parsed"], trace["after_clean"], trace["after_template"], trace["block"], trace["steps"], len(found["content_edges"]), len(found["nav_edges"])))
            yield pd.DataFrame(out, columns=["rec_id", "parsed", "after_clean", "after_template", "block", "steps", "content_edges", "nav_edges"])

    return rows.mapInPandas(safe(run), f"rec_id bigint, parsed int, after_clean int, after_template int, block int, steps {step}, content_edges int, nav_edges int")
