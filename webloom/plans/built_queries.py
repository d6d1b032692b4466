"""Round trips of the page operators: corpus rows are written as pages, read again, and compared with what went in.

Pages as they are crawled have no SQL; pages made of a table do: every field, text, edge and fingerprint that the operators read must be
the one that was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import audit as A
from webloom.operators import extraction as X
from webloom.operators import graph as G
from webloom.operators import pipeline as P
from webloom.plans.session import table
from webloom.plans.url_queries import HOME, WS, sql_dest, sql_host, sql_norm, sql_path

#: What stands in a page where a row has no date or no author.
DAY, AUTHOR = "2000-01-01", "Ban biên tập"


def _escaped(c: Column) -> Column:
    for raw, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(made))
    return c


def built_pages(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    """Raw records of pages made of corpus: fields as metadata, lines as paragraphs, links in the body (not with plain), a menu and a footer."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    author = T.clean_space(text("author"))
    author = F.when((author == "") | F.lower(author).isin(*sorted(dom.NO_AUTHOR)), AUTHOR).otherwise(author)
    day = T.normalize_date(F.col("published_at"))
    lines = F.filter(F.split(text("content"), "\n"), lambda x: U.strip(x) != "")
    paragraphs = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>¶ "), _escaped(x), F.lit("</p>"))), "\n")
    links = F.filter(F.coalesce("outgoing_links", F.array()), lambda x: x["url"].isNotNull())
    anchors = F.array_join(F.transform(links, lambda x: F.concat(F.lit('<p>→ <a href="'), _escaped(x["url"]), F.lit('">'), _escaped(F.coalesce(x["text"], F.lit(""))), F.lit("</a></p>"))), "\n")
    meta = lambda name, c: F.concat(F.lit(f'<meta {name} content="'), _escaped(c), F.lit('">'))
    page = F.concat(
        F.lit("<html><head><title>"), _escaped(text("title")), F.lit("</title>"), meta('property="og:title"', text("title")), meta('property="article:section"', text("section")),
        meta('name="author"', author), meta('property="article:published_time"', F.when(F.coalesce(day, F.lit("")) == "", DAY).otherwise(day)),
        F.lit('</head><body><nav><a href="/menu/">Menu</a></nav><div class="bodytext">'), paragraphs, F.lit("") if plain else anchors, F.lit("</div><footer><p>Foot</p></footer></body></html>"),
    )
    return table(spark, d, "corpus").select(F.col("row_id").alias("rec_id"), "url", F.lit(200).alias("status"), F.lit("utf-8").alias("encoding"), F.base64(F.encode(page, "UTF-8")).alias("html_b64"))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_pages(X.decoded(built_pages(spark, d)), HOME)


def built_fields(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("rec_id", "norm", "title", "title_src", "published_at", "published_at_src", "author", "author_src", "section")


def built_texts(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).select("rec_id", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"), F.col("word_count").cast("bigint").alias("words"), F.length("text").cast("bigint").alias("chars"))


def built_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _extracted(spark, d).select("rec_id", F.explode("content_edges").alias("e")).select("rec_id", "e.*")
    return edges.select("rec_id", "dst", "text", "dst_kind", F.col("count").cast("bigint").alias("n"))


def built_links(spark: SparkSession, d: str) -> DataFrame:
    """The table of links over the built pages: keys, and the hosts of both ends."""
    links = P.link_records(P.exploded_edges(_extracted(spark, d).where("norm is not null"), "content_edges"))
    return links.groupBy("src_host", "dst_host", "dst_kind").agg(F.countDistinct("_id").alias("n"))


def built_nav(spark: SparkSession, d: str) -> DataFrame:
    """Navigation over the built pages: every host's menu, on how many pages."""
    nav = P.nav_links(P.exploded_edges(_extracted(spark, d).where("norm is not null"), "nav_edges"))
    return nav.select("host", "dst", "text", "n_pages", "dst_kind")


def built_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    prints = X.page_fingerprints(X.decoded(built_pages(spark, d, plain=True)).where("norm is not null"))
    return prints.groupBy("norm").agg(F.count("fp").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"))


def built_templates(spark: SparkSession, d: str) -> DataFrame:
    return X.template_table(X.page_fingerprints(X.decoded(built_pages(spark, d, plain=True)).where("norm is not null")))


def built_articles(spark: SparkSession, d: str) -> DataFrame:
    """The export's rows of the built pages."""
    rows = A.article_rows(X.decoded(built_pages(spark, d)), HOME)
    return rows.select("id", "url", "lang", "title", "section", "author", "published_at", "modified_at", F.sha1(F.encode("summary", "UTF-8")).alias("summary_sha1"), F.sha1(F.encode("content", "UTF-8")).alias("content_sha1"), "word_count", "thumbnail", F.size("attachments").cast("bigint").alias("n_attachments"), F.size("images").cast("bigint").alias("n_images"), "source")


def built_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per host of the built pages: filled fields and how their blocks were found."""
    out = G.coverage(_extracted(spark, d).where("norm is not null"), ["title", "section", "text"], "block_method")
    return out.withColumn("methods", F.array_join(F.transform("methods", lambda m: F.concat_ws(":", m["method"], m["n"])), " "))


def built_hrefs(spark: SparkSession, d: str) -> DataFrame:
    """Links that an audit reads straight from the bytes of the built pages."""
    return A.page_links(built_pages(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("targets"))


def built_assets(spark: SparkSession, d: str) -> DataFrame:
    return A.assets(A.page_links(built_pages(spark, d)).select(F.col("dst").alias("url")), HOME)


def built_grep(spark: SparkSession, d: str) -> DataFrame:
    """Built pages whose decoded HTML holds a text, whatever the case."""
    return A.grep(X.decoded(built_pages(spark, d)), "page", "Học Bổng").select("rec_id", "norm")


QUERIES = {f.__name__: f for f in (built_fields, built_texts, built_edges, built_links, built_nav, built_fingerprints, built_templates, built_articles, built_coverage, built_hrefs, built_assets, built_grep)}

# ---------------------------------------------------------------- SQL


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


_AUTHOR = f"case when {_clean("coalesce(author, '')")} = '' or lower({_clean("coalesce(author, '')")}) in {tuple(sorted(dom.NO_AUTHOR))} then '{AUTHOR}' else {_clean("coalesce(author, '')")} end"
_LINES = f"list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_replace(x, '{WS}+', '', 'g') <> '')"
_PARTS = f"list_transform({_LINES}, lambda x: '¶ ' || regexp_replace(x, '{WS}+$', ''))"
_ANCHORS = f"flatten(list_transform(list_filter(coalesce(outgoing_links, []), lambda l: l.url is not null), lambda l: list_filter(['→', regexp_replace(coalesce(l.text, ''), '^{WS}+|{WS}+$', '', 'g')], lambda x: x <> '')))"


# where a page has no text its whole body is the block, menu included
MENU = "regexp_extract(norm, '^(https://[^/?#]*)', 1) || '/menu/'"


def _rows(date: str) -> str:
    return (
        f"b as (select row_id as rec_id, {sql_norm('u0')} as norm, url, {_clean("coalesce(title, '')")} as title, {_clean("coalesce(section, '')")} as section, {_AUTHOR} as author, coalesce(nullif({date}, ''), '{DAY}') as day,"
        f" array_to_string(list_concat({_PARTS}, {_ANCHORS}), chr(10)) as text, {_PARTS} as lines, outgoing_links from (select *, regexp_replace(url, '^\\s+|\\s+$', '', 'g') as u0 from corpus)),"
        " p as (select *, substring(text, 1, 200000) as stored from b where title <> '' or text <> '')"
    )


def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


def _sql() -> dict[str, str]:
    from webloom.plans.url_queries import SQL_DATE

    pages = _rows(SQL_DATE)
    first = f"{pages}, o as (select norm, min(rec_id) as rec_id from b where norm is not null group by norm), q as (select b.* from b join o using (rec_id))"
    prints = f"{first}, f as (select distinct norm, substring(sha1(regexp_replace(lower({_clean('x')}), '\\p{{Nd}}+', '0', 'g')), 1, 16) as fp from (select norm, unnest(list_append(lines, 'Foot')) as x from q))"
    edges = f"{pages}, l as (select rec_id, norm, unnest(list_filter(coalesce(outgoing_links, []), lambda l: l.url is not null)) as l from p), t as (select rec_id, norm, {sql_norm('l.url')} as dst, {_clean("coalesce(l.text, '')")} as text from l), e as (select * from t where dst is not null and dst is distinct from norm union all select rec_id, norm, {MENU}, 'Menu' from p where norm is not null and text = '')"
    linked = "replace(replace(replace(replace(l.url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    hrefs = f"{pages}, w as (select norm, unnest(list_filter(coalesce(outgoing_links, []), lambda l: l.url is not null)) as l from b), h as (select norm as src, {sql_norm('x')} as dst from (select norm, {linked} as x from w) union all select norm, {MENU} from b where norm is not null)"
    host = f"regexp_replace({sql_host('norm')}, '^www\\.', '')"
    return {
        "built_fields": f"with {pages} select rec_id, norm, substring(title, 1, 500) as title, case when title <> '' then 'og:title' else '' end as title_src, day as published_at, 'article:published_time' as published_at_src, author, 'meta' as author_src, section from p",
        "built_texts": f"with {pages} select rec_id, sha1(stored) as text_sha1, {_words('text')} as words, length(stored) as chars from p",
        "built_edges": f"with {edges} select rec_id, dst, text, {sql_dest('dst')} as dst_kind, count(*) as n from e group by rec_id, dst, text",
        "built_links": f"with {edges} select {sql_host('norm')} as src_host, {sql_host('dst')} as dst_host, {sql_dest('dst')} as dst_kind, count(distinct (norm, dst, text)) as n from e where norm is not null group by 1, 2, 3",
        "built_nav": f"with {pages}, m as (select {host} as host, {MENU} as dst from p where norm is not null and text <> '') select host, dst, 'Menu' as text, count(*) as n_pages, any_value({sql_dest('dst')}) as dst_kind from m group by host, dst",
        "built_fingerprints": f"with {prints} select norm, count(*) as n, min(fp) as least, max(fp) as most from f group by norm",
        "built_coverage": f"with {pages}, c as (select {host} as host, title, section, text, case when text = '' then 'fallback' else 'heuristic' end as m from p where norm is not null), n as (select host, m, count(*) as n from c group by host, m), l as (select host, string_agg(m || ':' || n, ' ' order by m) as methods from n group by host)"
        " select c.host, count(*) as pages, " + ", ".join(f"count(*) filter ({x} <> '') as {x}, round(100.0 * count(*) filter ({x} <> '') / count(*), 1)::double as {x}_pct" for x in ("title", "section", "text")) + ", any_value(l.methods) as methods from c join l using (host) group by c.host",
        "built_hrefs": f"with {hrefs} select src, count(*) as n, count(distinct dst) as targets from h where dst is not null group by src",
        "built_assets": f"with {hrefs} select lower(regexp_extract({sql_path('dst')}, '\\.([A-Za-z0-9]{{1,8}})$', 1)) as ext, count(distinct dst) as n from h where dst is not null and ({sql_host('dst')} = '{HOME}' or ends_with({sql_host('dst')}, '.{HOME}')) and regexp_matches({sql_path('dst')}, '{U.ASSET}') group by 1",
        "built_grep": f"with {pages} select rec_id, norm from b where contains(lower(concat_ws(' | ', title, section, author, text)), 'học bổng')",
        "built_templates": f"with {prints}, n as (select {host} as host, fp, count(*) as n from f group by 1, 2), s as (select {host} as host, count(*) as n_pages from q group by 1) select host, n_pages, fp, n from n join s using (host) where n >= greatest(3, n_pages * 0.05)",
        "built_articles": f"with {pages}, a as (select b.*, {_clean("array_to_string(list_concat(lines, " + _ANCHORS + "), ' ')")} as content from b) select coalesce(nullif(regexp_extract({sql_path('norm')}, '-(\\d+)\\.html$', 1), ''), norm, url) as id, coalesce(norm, url) as url, case when contains(coalesce(norm, url), '/en/') then 'en' else 'vi' end as lang,"
        f" title, nullif(section, '') as section, null::varchar as author, null::varchar as published_at, null::varchar as modified_at, sha1(case when length(content) > 300 then substring(content, 1, 300) || '…' else content end) as summary_sha1, sha1(content) as content_sha1, {_words('content')} as word_count, null::varchar as thumbnail,"
        f" len(list_filter(coalesce(outgoing_links, []), lambda l: regexp_matches(l.url, '(?i)\\.(pdf|docx?|xlsx?|pptx?|zip)$')))::bigint as n_attachments, 0::bigint as n_images, '{HOME}' as source from a",
    }


SQL = _sql()
