"""Extraction, record, graph and file queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import extraction as X
from webloom.operators import graph as G
from webloom.operators import pipeline as P
from webloom.operators import validation as V
from webloom.plans.session import materialize, stored, table
from webloom.sources import rawstore as R
from webloom.plans.url_queries import HOME, sql_dest, sql_ext, sql_host, sql_norm


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Decoded pages with their leaf fingerprints, written once for a version of raw_pages."""
    return stored(spark, d, "pages", ["raw_pages"], lambda: materialize(X.fingerprinted(X.decoded(X.first_per_url(raw(spark, d))))))


def _templates(spark: SparkSession, d: str) -> DataFrame:
    return X.active_templates(X.template_table(X.page_fingerprints(_pages(spark, d))))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """The extraction of all pages: run once for a version of raw_pages; records, links, navigation and images are read from it."""
    return stored(spark, d, "extraction", ["raw_pages"], lambda: materialize(X.extract_pages(_pages(spark, d), HOME, _templates(spark, d))))


def first_records(spark: SparkSession, d: str) -> DataFrame:
    return X.first_per_url(raw(spark, d)).select("rec_id", "url")


def find_record(spark: SparkSession, d: str) -> DataFrame:
    """The first record of a URL, the smallest one that page_labels names."""
    url = table(spark, d, "page_labels").agg(F.min("url")).first()[0] or ""
    return R.find_record(raw(spark, d).select("rec_id", "url", "store", "shard", "line_no"), [url])


def decoded_html(spark: SparkSession, d: str) -> DataFrame:
    return X.decoded(raw(spark, d)).select("rec_id", "norm", "host", F.length("page").alias("chars"), F.sha1(F.encode("page", "UTF-8")).alias("page_sha1"))


def leaf_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return X.page_fingerprints(_pages(spark, d))


def host_templates(spark: SparkSession, d: str) -> DataFrame:
    return X.template_table(X.page_fingerprints(_pages(spark, d)))


def line_templates(spark: SparkSession, d: str) -> DataFrame:
    """The template table over the lines of corpus, by the same counting: a form that SQL can express."""
    rows = table(spark, d, "corpus").where(F.length("content") > 0).select(F.col("row_id").alias("norm"), F.coalesce("host", F.lit("")).alias("host"), F.explode(F.split("content", "\n")).alias("line"))
    prints = rows.where(F.length(T.clean_space(F.col("line"))) >= 2).select("norm", "host", T.fingerprint(F.col("line")).alias("fp")).distinct()
    return X.template_table(prints)


def active_line_templates(spark: SparkSession, d: str) -> DataFrame:
    return X.active_templates(line_templates(spark, d))


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("rec_id", "norm", "title", "title_src", "published_at", "published_at_src", "author", "author_src", "cited_source", "section", "word_count", "block_path", "block_score", "block_method")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("rec_id", "text", "html")


def explain_blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.explain_pages(_pages(spark, d), HOME, _templates(spark, d))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.link_records(P.exploded_edges(_extracted(spark, d), "content_edges"))


def nav_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return P.nav_links(P.exploded_edges(_extracted(spark, d), "nav_edges"))


def nav_of_links(spark: SparkSession, d: str) -> DataFrame:
    """The aggregation of template edges over the table of links: a form that SQL can express."""
    edges = table(spark, d, "links").select(F.col("src_host").alias("host"), "src", "dst", F.col("edge_type").alias("type"), "text", "dst_kind")
    out = P.nav_links(edges.dropDuplicates(["src", "dst", "type", "text"]).withColumn("dst_kind", F.coalesce("dst_kind", F.lit(""))))
    return out.select("_id", "host", "dst", "type", "text", "dst_kind", "n_pages", F.array_join("sample_src", "|").alias("sample_src"))


def image_catalogue(spark: SparkSession, d: str) -> DataFrame:
    found = _extracted(spark, d)
    return P.images(P.exploded_edges(found, "content_edges"), P.exploded_edges(found, "nav_edges"))


def images_of_links(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of images over the table of links: links are content, embeds are template."""
    links = table(spark, d, "links")
    content = links.where("edge_type = 'href'").select("dst", U.dest_kind(F.col("dst"), HOME).alias("dst_kind"), "text")
    nav = links.where("edge_type <> 'href'").select("dst", U.dest_kind(F.col("dst"), HOME).alias("dst_kind"), "text")
    return P.images(content, nav).select("_id", "host", F.array_join("alts", "|").alias("alts"), "is_template")


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Articles from all raw records; a record counts as extracted if its status is below 400."""
    rows = raw(spark, d).select("rec_id", U.normalized(F.col("url")).alias("norm"), "store", "shard", "line_no", (F.coalesce("status", F.lit(0)) < 400).alias("ok"))
    out = P.resolve_entities(rows, ["store", "shard", "line_no", "rec_id"], "ok")
    return out.select("key", "primary_id", "primary_url", F.array_join("aliases", "|").alias("aliases"))


def _page_records(spark: SparkSession, d: str) -> DataFrame:
    extracted = _extracted(spark, d)
    order = raw(spark, d).select("rec_id", "store", "shard", "line_no")
    entities = P.resolve_entities(extracted.select("rec_id", "norm").join(order, "rec_id"), ["store", "shard", "line_no", "rec_id"])
    return P.page_records(extracted, entities, raw(spark, d))


def page_table(spark: SparkSession, d: str) -> DataFrame:
    return _page_records(spark, d).select("_id", F.size("aliases").alias("n_aliases"), "host", "lang", "kind", "title", "published_at", F.col("content.word_count").alias("word_count"), F.col("content.block.method").alias("method"), F.col("raw.sha1").alias("sha1"))


def extract_counters(spark: SparkSession, d: str) -> DataFrame:
    extracted = _extracted(spark, d)
    order = raw(spark, d).select("rec_id", "store", "shard", "line_no")
    entities = P.resolve_entities(extracted.select("rec_id", "norm").join(order, "rec_id"), ["store", "shard", "line_no", "rec_id"])
    content, nav = P.exploded_edges(extracted, "content_edges"), P.exploded_edges(extracted, "nav_edges")
    return P.counters(raw(spark, d), entities, content, nav, P.images(content, nav))


def link_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("link_id", T.sha1_key(*(F.coalesce(c, F.lit("")) for c in ("src", "dst", "edge_type", "text"))).alias("computed"))


def public_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page for the public schema: one row a target, with the first text that isn't empty."""
    rows = table(spark, d, "corpus").select("row_id", F.posexplode("outgoing_links").alias("pos", "link")).select("row_id", "pos", "link.url", "link.text")
    text = F.min_by(F.col("text"), F.when(F.coalesce("text", F.lit("")) != "", F.col("pos")))
    return rows.where(F.col("url").isNotNull()).groupBy("row_id", "url").agg(F.min("pos").cast("bigint").alias("pos"), F.coalesce(text, F.lit("")).alias("text"))


def upsert_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of one source host written again: its old edges go, the new ones come."""
    links = table(spark, d, "links").select("link_id", "src", "n_seen")
    new = links.where(F.col("src").startswith("https://tin.")).select("link_id", "src", F.lit(1).alias("n_seen"))
    return P.upsert(links, new.dropDuplicates(["link_id"]), "src")


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d).select("rec_id", U.normalized(F.col("url")).alias("norm"), "store", "shard", "line_no")
    entities = P.resolve_entities(rows, ["store", "shard", "line_no", "rec_id"])
    urls = table(spark, d, "links").select(U.normalized(F.col("dst")).alias("url")).distinct()
    return G.canonical(urls, entities).select("url", "primary", F.size("all_urls").alias("n_urls"))


def referrers(spark: SparkSession, d: str) -> DataFrame:
    """In-edges of the most linked page."""
    links = table(spark, d, "links")
    nav = P.nav_links(links.where("edge_type <> 'href'").select(F.col("src_host").alias("host"), "src", "dst", F.col("edge_type").alias("type"), "text", "dst_kind"))
    return G.referrers(links.where("edge_type = 'href'"), nav, [r["dst"] for r in G.top_targets(links, 1).collect()], 100)


def graph_out(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    first = links.agg(F.min("src").alias("s")).first()["s"]
    return G.out_edges(links, [first], raw(spark, d).select("url"), 50)


def graph_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.top_targets(table(spark, d, "links"), 30)


def dst_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.kinds(table(spark, d, "links"))


def coverage_by_host(spark: SparkSession, d: str) -> DataFrame:
    return G.coverage(table(spark, d, "corpus").withColumn("host", F.coalesce("host", F.lit(""))), ["title", "published_at", "author"])


def coverage_of_extraction(spark: SparkSession, d: str) -> DataFrame:
    return G.coverage(_extracted(spark, d), ["title", "published_at", "author"], "block_method")


def overview(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table, over the tables at hand: first records as pages, links and embeds as content and template, lines as templates."""
    links = table(spark, d, "links")
    nav = P.nav_links(links.where("edge_type <> 'href'").select(F.col("src_host").alias("host"), "src", "dst", F.col("edge_type").alias("type"), "text", "dst_kind"))
    return G.overview(raw(spark, d).select("url").distinct(), links.where("edge_type = 'href'"), nav, images_of_links(spark, d), line_templates(spark, d), table(spark, d, "files_ok"))


def store_overview(spark: SparkSession, d: str) -> DataFrame:
    """The same over the records of an extraction."""
    extracted = _extracted(spark, d)
    content, nav = P.exploded_edges(extracted, "content_edges"), P.exploded_edges(extracted, "nav_edges")
    return G.overview(_page_records(spark, d), content, P.nav_links(nav), P.images(content, nav), X.template_table(X.page_fingerprints(_pages(spark, d))), table(spark, d, "files_ok"))


def files_by_status(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files_ok")
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if(F.coalesce("needs_ocr", F.lit(False))).alias("needs_ocr"))


def images_listing(spark: SparkSession, d: str) -> DataFrame:
    return G.images_page(images_of_links(spark, d), False, 0, 50)


def referrer_totals(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    nav = P.nav_links(links.where("edge_type <> 'href'").select(F.col("src_host").alias("host"), "src", "dst", F.col("edge_type").alias("type"), "text", "dst_kind"))
    return G.referrer_totals(links.where("edge_type = 'href'"), nav, [r["dst"] for r in G.top_targets(links, 1).collect()])


def entity_counters(spark: SparkSession, d: str) -> DataFrame:
    """A run over the raw records that ends after 50 articles: articles, aliases, and of the whole store the records looked at in vain."""
    rows = raw(spark, d).select("rec_id", U.normalized(F.col("url")).alias("norm"), "store", "shard", "line_no", (F.coalesce("status", F.lit(0)) < 400).alias("ok"))
    order = ["store", "shard", "line_no", "rec_id"]
    few = P.resolve_entities(rows, order, "ok", 50).agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).cast("bigint").alias("aliases"))
    return few.withColumn("skipped", F.lit(P.skipped(rows, order, "ok").count()))


def files_listing(spark: SparkSession, d: str) -> DataFrame:
    files = G.with_referrer_counts(table(spark, d, "files_ok").where("status = 'ok'"), table(spark, d, "links"))
    return G.page_of_rows(files.select("file_id", "url", "host", "ext", "size", "referrers"), [F.col("url"), F.col("file_id")], 20, 100)


def files_referrers(spark: SparkSession, d: str) -> DataFrame:
    return G.with_referrer_counts(table(spark, d, "files_ok"), table(spark, d, "links")).select("file_id", "url", "referrers")


def catalog_files(spark: SparkSession, d: str) -> DataFrame:
    return G.catalog_files(table(spark, d, "links"), raw(spark, d), table(spark, d, "files_ok"), HOME)


def legacy_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files_ok").withColumn("status", F.when(F.col("ext").isin("doc", "xlsx"), "unsupported").otherwise(F.col("status")))
    return G.migrate_legacy(files).select("file_id", "status")


def download_states(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d).select("rec_id", "url", "status", "size", U.extension(F.col("url")).alias("ext"), (~F.col("url").contains("/viec-lam/")).alias("allowed"))
    return G.download_transition(rows).groupBy("next_status", "error").agg(F.count(F.lit(1)).alias("n"))


def document_states(spark: SparkSession, d: str) -> DataFrame:
    status, thin, text = G.extracted_status(F.col("text"), F.col("n_pages"), F.col("ext"))
    return table(spark, d, "files_ok").select("file_id", status.alias("status"), thin.alias("needs_ocr"), F.length(text).cast("bigint").alias("chars"))


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files alone as index documents with a title from their URL: the side of index_records that SQL can express."""
    pages = raw(spark, d).limit(0).select(F.col("url").alias("_id"), F.col("url").alias("title"), F.struct(F.col("url").alias("text")).alias("content"), F.col("url").alias("host"), F.col("url").alias("section"), F.col("url").alias("published_at"), F.col("url").alias("author"))
    out = P.index_documents(pages, table(spark, d, "files_ok"))
    return out.select("url", "title", "host", "kind", "ftype", F.length("text").cast("bigint").alias("chars"))


def index_records(spark: SparkSession, d: str) -> DataFrame:
    """Every page record and every readable file as index documents."""
    out = P.index_documents(_page_records(spark, d), table(spark, d, "files_ok"))
    return out.select("url", "title", "host", "section", "date", "date_num", "author", "kind", "ftype", F.length("text").cast("bigint").alias("chars"), F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"))


def looks_blocked(spark: SparkSession, d: str) -> DataFrame:
    html = F.decode(F.unbase64("html_b64"), "ISO-8859-1")
    return raw(spark, d).select("rec_id", U.looks_blocked(F.col("status"), html).alias("blocked"))


def corpus_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the public corpus that its rules reject, with the first rule each breaks."""
    return table(spark, d, "corpus").select("row_id", V.broken_rule().alias("rule")).where(F.col("rule").isNotNull())


def public_documents(spark: SparkSession, d: str) -> DataFrame:
    """The public corpus as it is taken in: valid rows, the last of each URL."""
    out = V.public_documents(table(spark, d, "corpus"), "row_id")
    return out.select("row_id", "url", "title", F.length("content").cast("bigint").alias("chars"), "host", "section", "date", "author", "kind", "sent")


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the files of the catalogue and the edges break, as records."""
    files = table(spark, d, "files_ok").select(F.col("url").alias("_id"), "status", "size", "n_pages")
    links = table(spark, d, "links").select(F.col("link_id").alias("_id"), "src", "dst", F.col("edge_type").alias("type"), "dst_kind", F.col("n_seen").alias("count"))
    return V.violations(files, "documents").unionByName(V.violations(links, "links"))


def store_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per store: records, readable ones, articles, shards and bytes."""
    return raw(spark, d).groupBy("store").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce("status", F.lit(200)) < 400).alias("done"), F.count_if(F.col("kind") == "article").alias("articles"),
        F.countDistinct("shard").alias("shards"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def link_violations(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the schema rejects: an unknown kind of target, or a negative count."""
    links = table(spark, d, "links")
    bad_kind = F.col("dst_kind").isNull() | ~F.col("dst_kind").isin("page", "document", "image", "external")
    return links.select("link_id", "src", F.when(bad_kind, "dst_kind").when(F.coalesce("n_seen", F.lit(0)) < 0, "count").alias("rule")).where(F.col("rule").isNotNull())


def edges_csv(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_csv(table(spark, d, "links"))


QUERIES = {
    f.__name__: f
    for f in (
        first_records, find_record, decoded_html, leaf_fingerprints, host_templates, line_templates, active_line_templates, extract_pages, page_texts, explain_blocks, page_edges, nav_aggregate, nav_of_links, image_catalogue,
        images_of_links, entity_resolution, page_table, extract_counters, link_keys, public_links, upsert_links, canonical_urls, referrers, graph_out, graph_in_degree, dst_kind_counts, coverage_by_host,
        coverage_of_extraction, overview, store_overview, files_by_status, images_listing, referrer_totals, entity_counters, files_listing, files_referrers, catalog_files, legacy_files, download_states, document_states, index_documents, index_records, looks_blocked, corpus_violations, public_documents, record_violations, store_totals, link_violations, edges_csv,
    )
}

# ---------------------------------------------------------------- SQL

WS = r"[\s\x1c-\x1f\p{Z}\x{0085}]"
KEY = "coalesce(case when regexp_matches(regexp_extract(norm, '^https://[^/?#]*([^?#]*)', 1), '-\\d+\\.html$') then regexp_extract(regexp_extract(norm, '^https://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) end, norm)"
VALID_DAY = r"coalesce(regexp_matches(substring(published_at, 1, 10), '^\d{4}-\d{2}-\d{2}$') and try_cast(substring(published_at, 1, 10) as date) is not null, false)"
OFFICE = "'pdf|msword|officedocument|ms-excel|ms-powerpoint|openxmlformats'"


def sql_entities(ok: str) -> str:
    return (
        f"with r as (select rec_id, norm, {KEY} as key, (store, shard, line_no, rec_id) as o, {ok} as ok from (select *, {sql_norm('url')} as norm from raw_pages) where norm is not null),"
        " p as (select key, min(o) as first, arg_min(rec_id, o) as primary_id, arg_min(norm, o) as primary_url from r where ok group by key),"
        " a as (select r.key, r.norm, min(r.o) as o from r join p using (key) where r.o > p.first and r.norm <> p.primary_url group by all)"
    )


LINES = (
    f"select distinct row_id, coalesce(host, '') as host, substring(sha1(regexp_replace(lower(trim(regexp_replace(l, '{WS}+', ' ', 'g'))), '\\p{{Nd}}+', '0', 'g')), 1, 16) as fp"
    f" from (select row_id, host, unnest(string_split(content, chr(10))) as l from corpus where length(content) > 0) where length(trim(regexp_replace(l, '{WS}+', ' ', 'g'))) >= 2"
)
TEMPLATES = f"with f as ({LINES}), p as (select host, count(distinct row_id) as n_pages from f group by host), n as (select host, fp, count(*) as n from f group by host, fp) select host, n_pages, fp, n from n join p using (host) where n >= greatest(3, n_pages * 0.05)"
#: Bytes of a page with escapes for what isn't printable ASCII: no test here looks at those
BLOB = "from_base64(html_b64)::varchar"
SQL = {
    "first_records": "select rec_id, url from raw_pages qualify row_number() over (partition by url order by store, shard, line_no, rec_id) = 1",
    "find_record": f"select rec_id, url, store, shard, line_no from raw_pages where {sql_norm('url')} = (select {sql_norm('min(url)')} from page_labels) order by store, shard, line_no, rec_id limit 1",
    "line_templates": TEMPLATES,
    "active_line_templates": f"select host, fp from ({TEMPLATES}) where n_pages >= 20 and n > 0.30 * n_pages",
    "nav_of_links": "with e as (select distinct src_host as host, src, dst, edge_type as type, text, coalesce(dst_kind, '') as dst_kind from (select * from links qualify row_number() over (partition by src, dst, edge_type, text order by link_id) = 1))"
    " select sha1(concat_ws('|', coalesce(host, ''), coalesce(dst, ''), coalesce(type, ''), coalesce(text, ''))) as _id, host, dst, type, text, arg_min(dst_kind, src) as dst_kind, count(*) as n_pages, array_to_string(list_slice(list(src order by src), 1, 3), '|') as sample_src from e group by host, dst, type, text",
    "images_of_links": f"select dst as _id, {sql_host('dst')} as host, array_to_string(list_sort(coalesce(list(distinct text) filter (edge_type = 'href' and coalesce(text, '') <> ''), [])), '|') as alts, not bool_or(edge_type = 'href') as is_template"
    f" from links where {sql_dest('dst')} = 'image' group by dst",
    "entity_resolution": sql_entities("coalesce(status, 0) < 400") + " select p.key, p.primary_id, p.primary_url, coalesce(string_agg(a.norm, '|' order by a.o), '') as aliases from p left join a using (key) group by all",
    "link_keys": "select link_id, sha1(concat_ws('|', coalesce(src, ''), coalesce(dst, ''), coalesce(edge_type, ''), coalesce(text, ''))) as computed from links",
    "public_links": "with l as (select row_id, unnest(outgoing_links) as link, unnest(range(len(outgoing_links))) as pos from corpus) select row_id, link.url as url, min(pos)::bigint as pos, coalesce(arg_min(link.text, pos) filter (coalesce(link.text, '') <> ''), '') as text from l where link.url is not null group by row_id, link.url",
    "upsert_links": "select link_id, src, n_seen from links where src not in (select src from links where starts_with(src, 'https://tin.')) union all select distinct link_id, src, 1 from links where starts_with(src, 'https://tin.')",
    "canonical_urls": sql_entities("true") + f", k as (select p.key, p.primary_url, a.norm from p left join a using (key)), m as (select primary_url as url, primary_url, key from p union select norm, primary_url, key from k where norm is not null), c as (select key, 1 + count(norm) as n from k group by key)"
    f" select u.url, coalesce(m.primary_url, u.url) as primary, coalesce(c.n, 1) as n_urls from (select distinct {sql_norm('dst')} as url from links) u left join (select url, any_value(primary_url) as primary_url, any_value(key) as key from m group by url) m on m.url = u.url left join c on c.key = m.key",
    "referrers": "with t as (select dst from links group by dst order by count(*) desc, dst limit 1), n as (select 'nav' as via, src_host as src, dst, edge_type as type, text, count(*) as weight from links where edge_type <> 'href' group by src_host, dst, edge_type, text)"
    " select * from (select * from n union all select 'content', src, dst, edge_type, text, n_seen::bigint from links where edge_type = 'href') where dst in (select dst from t) order by via desc, weight desc nulls last, src nulls first, text nulls first, type limit 100",
    "looks_blocked": f"with b as (select rec_id, status, coalesce(regexp_replace({BLOB}, '\\\\x(09|0A|0B|0C|0D)', ' ', 'g'), '') as x from raw_pages), w as (select *, len(list_filter(regexp_split_to_array(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+'), lambda w: w <> '')) as words, len(string_split(x, 'href=')) - 1 as links from b)"
    f" select rec_id, coalesce(status, 0) in (403, 429, 503) or regexp_matches(x, '{U.BLOCK_MARKS}') or (links <= 2 and words < 120) as blocked from w",
    "graph_in_degree": "select dst, count(*) as in_degree from links group by dst order by in_degree desc, dst limit 30",
    "graph_out": "select l.src, l.dst, l.edge_type, l.text, l.dst_kind, l.dst in (select url from raw_pages) as has_page from (select * from links where src = (select min(src) from links) order by dst, edge_type, text limit 50) l",
    "dst_kind_counts": "select dst_kind, count(*) as edges, count(distinct dst) as targets from links group by dst_kind",
    "coverage_by_host": "select coalesce(host, '') as host, count(*) as pages, "
    + ", ".join(f"count(*) filter (coalesce({c}, '') <> '') as {c}, round(100.0 * count(*) filter (coalesce({c}, '') <> '') / count(*), 1)::double as {c}_pct" for c in ("title", "published_at", "author"))
    + " from corpus group by 1",
    "files_by_status": "select status, count(*) as n, count(*) filter (length(text) > 0) as with_text, count(*) filter (coalesce(needs_ocr, false)) as needs_ocr from files_ok group by status",
    "files_listing": "select f.file_id, f.url, f.host, f.ext, f.size, coalesce(r.n, 0) as referrers from files_ok f left join (select dst, count(*) as n from links group by dst) r on r.dst = f.url where f.status = 'ok' order by f.url, f.file_id limit 100 offset 20",
    "files_referrers": "select f.file_id, f.url, coalesce(r.n, 0) as referrers from files_ok f left join (select dst, count(*) as n from links group by dst) r on r.dst = f.url",
    "catalog_files": f"select distinct url, {sql_host('url')} as host, {sql_ext('url')} as ext, 'pending' as status from (select dst as url from links where dst_kind = 'document' union all select url from raw_pages where html_b64 is null and regexp_matches(lower(coalesce(content_type, '')), {OFFICE}) and coalesce(status, 200) < 400)"
    f" where ({sql_host('url')} = '{HOME}' or ends_with({sql_host('url')}, '.{HOME}')) and url not in (select url from files_ok where url is not null)",
    "legacy_files": "select file_id, case when s = 'unsupported' and ext in ('doc', 'xls', 'ppt') then 'pending' else s end as status from (select *, case when ext in ('doc', 'xlsx') then 'unsupported' else status end as s from files_ok)",
    "download_states": f"with r as (select coalesce(status, 0) as s, coalesce(size, 0) as z, {sql_ext('url')} as ext, not contains(url, '/viec-lam/') as ok from raw_pages)"
    f" select case when not ok then 'error' when s = 429 then 'pending' when s >= 400 or s = 0 then 'error' when z > 52428800 then 'skipped_too_large' when ext not in {U.DOCUMENT_EXT} then 'unsupported' else 'downloaded' end as next_status,"
    " case when not ok then 'robots' when s = 429 then 'retry' when s >= 400 then 'http ' || s when s = 0 then 'no answer' else '' end as error, count(*) as n from r group by 1, 2",
    "document_states": f"with f as (select file_id, ext, coalesce(text, '') as text, coalesce(n_pages, 1) as p from files_ok) select file_id, case when ext not in {U.DOCUMENT_EXT} then 'unsupported' else 'ok' end as status, ext = 'pdf' and p > 0 and length(text) < 20 * p as needs_ocr,"
    " case when ext = 'pdf' and p > 0 and length(text) < 20 * p then 0 else least(length(text), 500000) end as chars from f",
    "index_documents": r"select url, url_decode(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1)) as title, host, 'document' as kind, ext as ftype, length(text) as chars from files_ok where status = 'ok' and length(text) > 0",
    "corpus_violations": "with c as (select row_id, coalesce(regexp_matches(url, '(?i)^https?://'), false) as u, kind is null or kind in ('page', 'document') as k, coalesce(title, '') <> '' or coalesce(content, '') <> '' as s, coalesce(substring(published_at, 1, 10), '') as d from corpus)"
    " select row_id, rule from (select row_id, case when not u then 'url' when not k then 'kind' when not s then 'title or content' when not (trim(d) = '' or coalesce(regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') and try_cast(d as date) is not null, false)) then 'published_at' end as rule from c) where rule is not null",
    "public_documents": f"with g as (select * from corpus where coalesce(regexp_matches(url, '(?i)^https?://'), false) and (kind is null or kind in ('page', 'document')) and (coalesce(title, '') <> '' or coalesce(content, '') <> '') and (trim(coalesce(substring(published_at, 1, 10), '')) = '' or {VALID_DAY})),"
    f" l as (select url, max(row_id) as row_id, count(*) as sent from g group by url) select g.row_id, g.url, substring(coalesce(title, ''), 1, 500) as title, least(length(coalesce(content, '')), 200000) as chars, case when trim(coalesce(host, '')) <> '' then lower(trim(host)) else regexp_replace({sql_host('g.url')}, '^www\\.', '') end as host,"
    f" coalesce(section, '') as section, case when {VALID_DAY} then substring(published_at, 1, 10) else '' end as date, coalesce(author, '') as author, coalesce(kind, 'page') as kind, sent from g join l using (row_id)",
    "record_violations": "select url as key, 'size' as rule from files_ok where size < 0 union all select url, 'n_pages' from files_ok where n_pages < 0 union all select url, 'status' from files_ok where status is null or status not in ('pending', 'ok', 'unsupported', 'skipped_too_large', 'error')"
    " union all select url, '_id' from files_ok where coalesce(url, '') = '' union all select link_id, '_id' from links where coalesce(link_id, '') = '' union all select link_id, 'src' from links where coalesce(src, '') = '' union all select link_id, 'dst' from links where coalesce(dst, '') = ''"
    " union all select link_id, 'type' from links where edge_type is null or edge_type not in ('href', 'embed') union all select link_id, 'dst_kind' from links where dst_kind is null or dst_kind not in ('page', 'document', 'image', 'external') union all select link_id, 'count' from links where n_seen is null or n_seen < 0",
    "store_totals": "select store, count(*) as records, count(*) filter (coalesce(status, 200) < 400) as done, count(*) filter (kind = 'article') as articles, count(distinct shard) as shards, coalesce(sum(size), 0)::bigint as bytes from raw_pages group by store",
    "link_violations": "select link_id, src, rule from (select link_id, src, case when dst_kind is null or dst_kind not in ('page', 'document', 'image', 'external') then 'dst_kind' when coalesce(n_seen, 0) < 0 then 'count' end as rule from links) where rule is not null",
    "edges_csv": "select src as source, dst as target, coalesce(text, '') as text from links",
}
IMAGES = SQL["images_of_links"]
SQL |= {
    "images_listing": f"select * from ({IMAGES}) where not is_template order by _id limit 50",
    "referrer_totals": "with t as (select dst from links group by dst order by count(*) desc, dst limit 1) select 'nav' as via, count(*) as n from (select distinct src_host, dst, edge_type, text from links where edge_type <> 'href' and dst in (select dst from t))"
    " union all select 'content', count(*) from links where edge_type = 'href' and dst in (select dst from t)",
    "overview": f"select 'pages' as what, (select count(*) from (select distinct url from raw_pages)) as n union all select 'links', count(*) from links where edge_type = 'href' union all select 'nav_links', count(*) from (select distinct src_host, dst, edge_type, text from links where edge_type <> 'href')"
    f" union all select 'images', count(*) from ({IMAGES}) union all select 'templates', count(distinct host) from ({TEMPLATES}) union all select 'templates_active', count(distinct host) from ({TEMPLATES}) where n_pages >= 20"
    " union all select 'documents_text', count(*) from files_ok where length(text) > 0 union all select 'documents:' || coalesce(status, ''), count(*) from files_ok group by 1",
    "entity_counters": sql_entities("coalesce(status, 0) < 400") + ", few as (select * from p order by first limit 50), seen as (select * from r where o <= (select max(first) from few)), al as (select s.key, s.norm from seen s join few f using (key) where s.o > f.first and s.norm <> f.primary_url group by all)"
    " select (select count(*) from few) as articles, (select count(*) from al) as aliases, (select count(*) from r left join p using (key) where not r.ok and (p.first is null or r.o < p.first)) as skipped",
}
