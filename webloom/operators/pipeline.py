"""Record tables from extracted pages: entity resolution, links, navigation, images, index documents, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions.hosts import url_host
from webloom.functions.urls import dedup_key, lang_of
from webloom.operators import extraction
from webloom.plans.session import materialize

EXTRACTOR_VERSION = "2"


def resolve_entities(records: DataFrame, order: list[str], ok: str | None = None, limit: int | None = None) -> DataFrame:
    """key, primary_id, primary_url, aliases: one row per article.

    records: rec_id, norm and the order columns. An article's key is the last path segment of its URL, else the whole URL; its
    primary is the first record in order whose extraction went well; later records' other URLs are its aliases, in order of arrival. With
    limit a run ends after so many articles.
    """
    good = F.col(ok) if ok else F.lit(True)
    rows = records.where(F.col("norm").isNotNull()).withColumn("key", F.coalesce(dedup_key(F.col("norm")), F.col("norm"))).withColumn("o", F.struct(*order))
    primary = rows.where(good).groupBy("key").agg(F.min(F.struct("o", "rec_id", "norm")).alias("p")).select("key", "p.o", "p.rec_id", "p.norm")
    primary = primary.select("key", F.col("o").alias("first"), F.col("rec_id").alias("primary_id"), F.col("norm").alias("primary_url"))
    if limit is not None:
        primary = materialize(primary.orderBy("first").limit(limit))
        last = primary.agg(F.max("first").alias("end"))
        rows = rows.join(F.broadcast(last), F.col("o") <= F.col("end")).drop("end")  # a single row
    later = rows.join(primary, "key").where((F.col("o") > F.col("first")) & (F.col("norm") != F.col("primary_url")))
    # an article's distinct other URLs are few, whatever number of times they were fetched
    others = later.groupBy("key", "norm").agg(F.min("o").alias("o")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o", "norm"))).alias("a"))
    others = others.select("key", F.transform("a", lambda x: x["norm"]).alias("aliases"))
    return primary.join(others, "key", "left").select("key", "primary_id", "primary_url", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def page_records(extracted: DataFrame, entities: DataFrame, raw: DataFrame) -> DataFrame:
    """The table of pages: one record per article, keyed by its canonical URL."""
    fetched = raw.select(F.col("rec_id").alias("primary_id"), F.col("kind"), F.col("fetched_at"), "sha1")
    rows = entities.join(extracted.withColumnRenamed("rec_id", "primary_id"), "primary_id").join(fetched, "primary_id")
    return rows.select(
        F.col("norm").alias("_id"), "aliases", "host", lang_of(F.col("norm")).alias("lang"), "kind", "title", "title_src", "published_at", "published_at_src", "author", "author_src", "cited_source", "section",
        F.struct("text", "html", "word_count", F.struct(F.col("block_path").alias("path"), F.col("block_score").alias("score"), F.col("block_method").alias("method")).alias("block")).alias("content"),
        F.struct("sha1", "fetched_at").alias("raw"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
    )


def exploded_edges(extracted: DataFrame, side: str) -> DataFrame:
    """src, host, dst, type, text, dst_kind, count of one side's edges (content_edges or nav_edges)."""
    return extracted.select(F.col("norm").alias("src"), "host", F.explode(side).alias("e")).select("src", "host", "e.*")


def link_records(edges: DataFrame) -> DataFrame:
    """The table of links, keyed by the SHA-1 of source, target, type and text."""
    key = T.sha1_key(*(F.coalesce(c, F.lit("")) for c in ("src", "dst", "type", "text")))
    return edges.select(key.alias("_id"), "src", "dst", "type", "text", "dst_kind", "count", url_host(F.col("src")).alias("src_host"), url_host(F.col("dst")).alias("dst_host"))


def nav_links(edges: DataFrame, order: str = "src") -> DataFrame:
    """The template's edges by host, target, type and text: on how many pages, the first kind, and up to three sources in order.

    A window of three ranks keeps the sources bounded, however many pages an edge stands on.
    """
    key = ["host", "dst", "type", "text"]
    pages = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pages"), F.min_by("dst_kind", order).alias("dst_kind"))
    ranked = edges.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("r <= 3")
    samples = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "src"))), lambda x: x["src"]).alias("sample_src"))
    same = [pages[k].eqNullSafe(samples[k]) for k in key]
    joined = pages.join(samples, same[0] & same[1] & same[2] & same[3])
    return joined.select(T.sha1_key(*(F.coalesce(pages[k], F.lit("")) for k in key)).alias("_id"), *(pages[k] for k in key), "dst_kind", "n_pages", "sample_src")


def images(content: DataFrame, nav: DataFrame) -> DataFrame:
    """The catalogue of images: distinct texts of content edges, and whether only templates show it."""
    both = content.select("dst", "dst_kind", "text", F.lit(True).alias("c")).unionByName(nav.select("dst", "dst_kind", "text", F.lit(False).alias("c"))).where("dst_kind = 'image'")
    shown = F.when(F.col("c") & (F.coalesce("text", F.lit("")) != ""), F.col("text"))
    return both.groupBy("dst").agg(F.array_sort(F.collect_set(shown)).alias("alts"), (~F.max("c")).alias("is_template")).select(F.col("dst").alias("_id"), url_host(F.col("dst")).alias("host"), "alts", "is_template")


def skipped(records: DataFrame, order: list[str], ok: str) -> DataFrame:
    """rec_id of the records that a run looked at in vain: not extracted, and no earlier record of their article was."""
    rows = records.where(F.col("norm").isNotNull()).withColumn("key", F.coalesce(dedup_key(F.col("norm")), F.col("norm"))).withColumn("o", F.struct(*order))
    first = rows.where(F.col(ok)).groupBy("key").agg(F.min("o").alias("first"))
    return rows.where(~F.col(ok)).join(first, "key", "left").where(F.col("first").isNull() | (F.col("o") < F.col("first"))).select("rec_id")


def counters(records: DataFrame, entities: DataFrame, content: DataFrame, nav: DataFrame, pictures: DataFrame) -> DataFrame:
    """counter, n: how many records, pages, links, template edges and images an extraction run has."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    out = count(entities, "pages")
    for df, name in ((records, "records"), (content, "links"), (nav, "nav_links"), (pictures, "images")):
        out = out.unionByName(count(df, name))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new's keys replaced; of new's rows with one key any is taken, so give each key once."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old without the rows of some keys."""
    return old.join(keys.select(key).distinct(), key, "left_anti")


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in order, by one aggregation; null keys are one key."""
    packed = df.groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("r"))).alias("m"))
    return packed.select("m.r.*")


def index_documents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages and readable files as index documents; a file's title is the last segment of its URL."""
    p = pages.select(F.col("_id").alias("url"), "title", F.col("content.text").alias("text"), "host", "section", F.col("published_at").alias("date"), "author", F.lit("page").alias("kind"), F.lit("html").alias("ftype"))
    name = F.regexp_extract("url", "([^/?#]*)(?:[?#].*)?$", 1)
    f = files.where((F.col("status") == "ok") & (F.length("text") > 0)).select(
        "url", F.coalesce(F.try_url_decode(name), name).alias("title"), "text", "host", F.lit("").alias("section"), F.lit("").alias("date"), F.lit("").alias("author"), F.lit("document").alias("kind"), F.col("ext").alias("ftype")
    )
    return p.unionByName(f).withColumn("date_num", T.date_num(F.col("date")))


def write_single(tables: dict[str, DataFrame], page: DataFrame, content: DataFrame, pictures: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables after one page was extracted again: its record and links are replaced, its images' texts added, files not
    yet known are catalogued; template edges stay as they are. Running it twice changes nothing more.
    """
    shown = tables["images"].select("_id", "host", F.explode_outer("alts").alias("alt"), "is_template").unionByName(pictures.select("_id", "host", F.explode_outer("alts").alias("alt"), "is_template"))
    merged = shown.groupBy("_id").agg(F.first("host").alias("host"), F.array_sort(F.collect_set("alt")).alias("alts"), F.min("is_template").alias("is_template"))
    links = tables["links"].join(page.select(F.col("_id").alias("src")).distinct(), "src", "left_anti").unionByName(content)
    known = tables["documents"].unionByName(files.join(tables["documents"].select("_id"), "_id", "left_anti"))
    return tables | {"pages": upsert(tables["pages"], page, "_id"), "links": links.select(*tables["links"].columns), "images": merged.select(*tables["images"].columns), "documents": known}


def index_source(pages: DataFrame | None, source: str = "auto") -> str:
    """Where an index is built from: records if there are any, else the raw store; or as asked."""
    if source not in ("auto", "records", "raw"):
        raise ValueError("source is auto, records or raw")
    if source == "records" and pages is None:
        raise ValueError("there are no records")
    if source == "auto":
        return "raw" if pages is None or pages.isEmpty() else "records"
    return source


def index_rows(pages: DataFrame | None, raw: DataFrame, files: DataFrame | None, home: str, source: str = "auto", limit: int = 0) -> DataFrame:
    """Index documents from page records, or from the raw store extracted anew, with the readable files of the catalogue; with limit that
    many by URL. Ids are hashed from the URLs, so a document written again keeps its own. Batches are Spark's affair."""
    if index_source(pages, source) == "raw":
        found = extraction.extract_pages(extraction.decoded(extraction.first_per_url(raw)), home)
        pages = found.select(F.col("norm").alias("_id"), "title", F.struct("text").alias("content"), "host", "section", "published_at", "author")
    none = pages.limit(0).select(*[F.lit("").alias(c) for c in ("url", "host", "ext", "text", "status")])
    rows = index_documents(pages, none if files is None else files).withColumn("id", F.xxhash64("url"))
    return rows.orderBy("url").limit(limit) if limit else rows
