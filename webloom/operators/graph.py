"""Link graph, coverage, catalogue and file queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import DOCUMENT_EXT, extension, hostname, in_family


def canonical(urls: DataFrame, entities: DataFrame) -> DataFrame:
    """url, primary, all_urls of every given URL: itself, unless it is an alias."""
    alias = entities.select(F.explode(F.concat(F.array("primary_url"), "aliases")).alias("url"), F.col("primary_url").alias("p"), F.concat(F.array("primary_url"), "aliases").alias("known")).dropDuplicates(["url"])
    found = urls.join(alias, "url", "left")
    return found.select("url", F.coalesce("p", "url").alias("primary"), F.coalesce("known", F.array("url")).alias("all_urls"))


def referrers(links: DataFrame, nav: DataFrame, targets: list[str], limit: int) -> DataFrame:
    """In-edges of a page under any of its URLs: template rows first, by the pages that carry them, then content edges."""
    a = nav.where(F.col("dst").isin(targets)).select(F.lit("nav").alias("via"), F.col("host").alias("src"), "dst", "type", "text", F.col("n_pages").cast("bigint").alias("weight"))
    b = links.where(F.col("dst").isin(targets)).select(F.lit("content").alias("via"), "src", "dst", F.col("edge_type").alias("type"), "text", F.col("n_seen").cast("bigint").alias("weight"))
    return a.unionByName(b).orderBy(F.col("via").desc(), F.col("weight").desc_nulls_last(), "src", "text", "type").limit(limit)


def referrer_totals(links: DataFrame, nav: DataFrame, targets: list[str]) -> DataFrame:
    """via, n: how many template rows and content edges lead to a page in all, beyond the listed ones."""
    count = lambda df, name: df.where(F.col("dst").isin(targets)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("via"), "n")
    return count(nav, "nav").unionByName(count(links, "content"))


def out_edges(links: DataFrame, sources: list[str], known: DataFrame, limit: int) -> DataFrame:
    """Out-edges of a page, and whether their target is a known page."""
    mine = links.where(F.col("src").isin(sources)).orderBy("dst", "edge_type", "text").limit(limit)
    there = known.select(F.col("url").alias("dst"), F.lit(True).alias("known")).distinct()
    return mine.join(there, "dst", "left").select("src", "dst", "edge_type", "text", "dst_kind", F.coalesce("known", F.lit(False)).alias("has_page"))


def top_targets(links: DataFrame, top: int) -> DataFrame:
    return links.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree")).orderBy(F.col("in_degree").desc(), "dst").limit(top)


def kinds(links: DataFrame) -> DataFrame:
    return links.groupBy("dst_kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("dst").alias("targets"))


def coverage(pages: DataFrame, fields: list[str], method: str | None = None) -> DataFrame:
    """Per host: pages, non-empty fields with their percentages, and (given a method column) a histogram of methods."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    total = F.count(F.lit(1))
    out = pages.groupBy("host").agg(total.alias("pages"), *[filled(c).alias(c) for c in fields], *[F.round(100 * filled(c) / total, 1).alias(f"{c}_pct") for c in fields])
    if method is None:
        return out
    counted = pages.groupBy("host", method).agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.col(method).alias("method"), "n"))).alias("methods"))
    return out.join(counted, "host", "left")


def overview(pages: DataFrame, links: DataFrame, nav: DataFrame, images: DataFrame, templates: DataFrame, files: DataFrame, least_pages: int = 20) -> DataFrame:
    """what, n: rows of every table, hosts with templates and those of them with pages enough to use them, files by status, and files with text."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    hosts = templates.groupBy("host").agg(F.max("n_pages").alias("n_pages"))
    out = count(pages, "pages")
    for df, name in ((links, "links"), (nav, "nav_links"), (images, "images"), (hosts, "templates"), (hosts.where(F.col("n_pages") >= least_pages), "templates_active"), (files.where(F.length("text") > 0), "documents_text")):
        out = out.unionByName(count(df, name))
    by = files.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("documents:"), F.coalesce("status", F.lit(""))).alias("what"), "n")
    return out.unionByName(by)


def images_page(images: DataFrame, is_template: bool | None, skip: int, limit: int) -> DataFrame:
    """A page of the catalogue of images by URL: all, or those that only templates show, or the others."""
    rows = images if is_template is None else images.where(F.col("is_template") == F.lit(is_template))
    return page_of_rows(rows, [F.col("_id")], skip, limit)


def with_referrer_counts(files: DataFrame, links: DataFrame) -> DataFrame:
    """Every file with the number of content edges that lead to it."""
    n = links.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("referrers"))
    return files.join(n, "url", "left").withColumn("referrers", F.coalesce("referrers", F.lit(0)))


def page_of_rows(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """Rows skip .. skip + limit in order; at most 200."""
    return df.orderBy(*order).offset(max(0, skip)).limit(max(1, min(limit, 200)))


def catalog_files(links: DataFrame, raw: DataFrame, known: DataFrame, home: str) -> DataFrame:
    """url, host, ext of documents not yet in the catalogue: targets of content edges, and raw records that are files themselves."""
    office = F.lower(F.coalesce("content_type", F.lit(""))).rlike("pdf|msword|officedocument|ms-excel|ms-powerpoint|openxmlformats")
    found = links.where("dst_kind = 'document'").select(F.col("dst").alias("url")).unionByName(
        raw.where(F.col("html_b64").isNull() & office & (F.coalesce("status", F.lit(200)) < 400)).select("url")
    )
    fresh = found.where(F.col("url").isNotNull() & in_family(hostname(F.col("url")), home)).distinct().join(known.select("url").distinct(), "url", "left_anti")
    return fresh.select("url", hostname(F.col("url")).alias("host"), extension(F.col("url")).alias("ext"), F.lit("pending").alias("status"))


def migrate_legacy(files: DataFrame) -> DataFrame:
    """Legacy office formats that were unsupported go back to pending."""
    again = (F.col("status") == "unsupported") & F.col("ext").isin("doc", "xls", "ppt")
    return files.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def download_transition(responses: DataFrame, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """The next status of each file from a recorded response, by the order of precedence of the rules."""
    status, size = F.coalesce("status", F.lit(0)), F.coalesce("size", F.lit(0))
    allowed = F.coalesce("allowed", F.lit(True))
    next_status = (
        F.when(~allowed, "error").when(status == 429, "pending").when((status >= 400) | (status == 0), "error").when(size > max_bytes, "skipped_too_large")
        .when(~F.col("ext").isin(*DOCUMENT_EXT), "unsupported").otherwise("downloaded")
    )
    reason = F.when(~allowed, "robots").when(status == 429, "retry").when(status >= 400, F.concat(F.lit("http "), status.cast("string"))).when(status == 0, "no answer").otherwise("")
    return responses.select("url", next_status.alias("next_status"), reason.alias("error"))


def extracted_status(text, pages, ext) -> tuple:
    """(status, needs_ocr, text) columns of an extracted document: scans with hardly any text a page need recognition."""
    thin = (ext == "pdf") & (F.coalesce(pages, F.lit(1)) > 0) & (F.length(F.coalesce(text, F.lit(""))) < 20 * F.coalesce(pages, F.lit(1)))
    kept = F.substring(F.coalesce(text, F.lit("")), 1, 500_000)
    return F.when(~ext.isin(*DOCUMENT_EXT), "unsupported").otherwise("ok"), thin, F.when(thin, "").otherwise(kept)


def edges_csv(links: DataFrame) -> DataFrame:
    """source, target, text for the CSV of edges."""
    return links.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("text", F.lit("")).alias("text"))
