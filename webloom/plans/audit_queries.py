"""Audit, export, frontier and source queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import audit as A
from webloom.operators import extraction as X
from webloom.operators import frontier as L
from webloom.plans.record_queries import raw
from webloom.plans.session import table
from webloom.plans.url_queries import HOME, sql_ext, sql_host, sql_norm, sql_page, sql_path, sql_scope
from webloom.sources.rawstore import sitemap_entries, unseen_urls


def _records(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(U.normalized(F.col("url")).alias("url"), "html_b64", "status", "kind")


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select(U.normalized(F.col("dst")).alias("url")).where(F.col("url").isNotNull())


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.store_stats(X.first_per_url(raw(spark, d)), raw(spark, d))


def store_check(spark: SparkSession, d: str) -> DataFrame:
    return A.check_done(_known(spark, d), _records(spark, d), HOME)


def store_grep(spark: SparkSession, d: str) -> DataFrame:
    return A.grep(table(spark, d, "corpus").select("row_id", "url", "content"), "content", "Học Bổng").select("row_id", "url")


def page_hrefs(spark: SparkSession, d: str) -> DataFrame:
    return A.page_links(raw(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("targets"))


def page_assets(spark: SparkSession, d: str) -> DataFrame:
    return A.assets(A.page_links(raw(spark, d)).select(F.col("dst").alias("url")), HOME)


def link_assets(spark: SparkSession, d: str) -> DataFrame:
    return A.assets(_known(spark, d), HOME)


def category_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.audit_categories(_records(spark, d), _known(spark, d))


def rebuilt_state(spark: SparkSession, d: str) -> DataFrame:
    return A.rebuild_state(_records(spark, d), _known(spark, d))


def fix_roots(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_roots(_records(spark, d), _known(spark, d))


def verify_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of stored pages against the link file, within the crawl's scope."""
    scope = lambda df: df.where(U.in_scope(F.col("url"), HOME, suffix=True))
    return A.verify_links(scope(A.page_links(raw(spark, d)).select(F.col("dst").alias("url"))), scope(_known(spark, d)))


def verify_corpus_links(spark: SparkSession, d: str) -> DataFrame:
    """The same between the links sent with the corpus and the link file: a form that SQL can express."""
    sent = table(spark, d, "corpus").select(F.explode("outgoing_links").alias("l")).select(U.normalized(F.col("l.url")).alias("url")).where(F.col("url").isNotNull())
    return A.verify_links(sent, _known(spark, d))


def all_links(spark: SparkSession, d: str) -> DataFrame:
    sent = table(spark, d, "corpus").select(U.normalized(F.col("url")).alias("url"))
    return A.all_links(_records(spark, d).select("url"), _known(spark, d), sent, home=HOME)


def subdomains(spark: SparkSession, d: str) -> DataFrame:
    return A.subdomains(_known(spark, d), HOME)


def article_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the article export for every article page, with the views of its listing's card."""
    first = X.first_per_url(raw(spark, d))
    pages = X.decoded(first.where("kind = 'article'")).join(first.select("rec_id", "fetched_at"), "rec_id")
    return A.export_rows(A.article_rows(pages, HOME), listing_cards(spark, d))


def listing_cards(spark: SparkSession, d: str) -> DataFrame:
    return A.listing_cards(X.decoded(raw(spark, d).where(F.col("kind").isin("listing", "listing-page"))))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select(U.normalized(F.col("url")).alias("url"), F.coalesce(F.substring("fetched_at", 1, 10), F.lit("")).alias("lastmod"))


def fetch_candidates(spark: SparkSession, d: str) -> DataFrame:
    seen = _listed(spark, d).where(F.col("url").startswith("https://tin.")).select(U.art_id(F.col("url")).alias("article_id"), "lastmod").where("article_id is not null")
    return A.candidates(_listed(spark, d), seen, "2020-01-01", 100)


def filled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Empty sections of the corpus filled from the other rows of their host."""
    rows = table(spark, d, "corpus").select("row_id", "host", F.coalesce("section", F.lit("")).alias("section"))
    cards = rows.where("section <> ''").select("host", "section")
    return A.fill_gaps(rows, cards, "host", ["section"]).select("row_id", "host", "section")


def merged_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _listed(spark, d).select(U.art_id(F.col("url")).alias("article_id"), "lastmod").where("article_id is not null")
    return A.merge_seen(rows.where("lastmod < '2021'"), rows.where("lastmod >= '2021'"))


def sorted_articles(spark: SparkSession, d: str) -> DataFrame:
    """All articles and pages in the export's order: newest first."""
    return _listed(spark, d).orderBy(F.col("lastmod").desc(), "url")


def frontier_push(spark: SparkSession, d: str) -> DataFrame:
    """One round: links of stored pages that join the queue behind what is fetched."""
    found = table(spark, d, "links").select(F.col("dst").alias("url"), F.lit(1).alias("depth"), F.col("src").alias("via"), F.col("link_id").alias("ord"))
    u = U.normalized(F.col("url"))
    queued = raw(spark, d).select(F.coalesce(U.dedup_key(u), u).alias("key")).where("key is not null")
    return L.push(found, queued, HOME)


def frontier_walk(spark: SparkSession, d: str) -> DataFrame:
    seeds = raw(spark, d).where("kind = 'listing'").select("url")
    return L.walk(table(spark, d, "links").select("src", "dst"), seeds, HOME)


def visited_split(spark: SparkSession, d: str) -> DataFrame:
    return L.split_visited(table(spark, d, "links"), HOME)


def pagination(spark: SparkSession, d: str) -> DataFrame:
    return L.expand_pagination(_records(spark, d).select("url").union(_known(spark, d)))


def crawl_pacing(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d).select(U.hostname(F.col("url")).alias("host"), F.col("rec_id").alias("ord"), F.when(F.col("status") == 503, 429).otherwise(F.col("status")).alias("status"))
    return L.pacing(rows)


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers of each URL as the attempts of a fetch."""
    return L.fetch_outcomes(raw(spark, d).select("url", F.col("rec_id").alias("ord"), "status"))


def recent_listing(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a host in order stand for the cards of a listing page."""
    cards = table(spark, d, "documents").where(F.col("source").isNotNull()).select(F.col("source").alias("page_url"), F.col("doc_id").alias("pos"), F.date_format("fetched_at", "yyyy-MM-dd").alias("date"))
    return L.recent_listing(cards, "2020-01-01", "2023-12-31")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source in order of their ids stand for the cards of its listing, twenty a page."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = table(spark, d, "documents").where(F.col("source").isNotNull()).select(F.col("source").alias("listing"), place.cast("bigint").alias("pos"), "url", F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("")).alias("date"))
    return rows.withColumn("page_no", F.floor(F.col("pos") / 20))


def recent_links(spark: SparkSession, d: str) -> DataFrame:
    """The links that a walk of recent listings takes."""
    return L.recent_links(_cards(spark, d), "2020-01-01", "2023-12-31").select("listing", "page_no", "pos", "url", "date")


def recent_queue(spark: SparkSession, d: str) -> DataFrame:
    """Those of them that join the front of the queue, behind what is fetched."""
    u = U.normalized(F.col("url"))
    queued = raw(spark, d).select(F.coalesce(U.dedup_key(u), u).alias("key")).where("key is not null")
    return L.queue_recent(recent_links(spark, d), queued, HOME, 500).select("url", "key", "depth", "via", "front")


def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """A walk of at most 100 pages: what is done and what is parked."""
    return L.within_budget(frontier_walk(spark, d), 100).select("url", "depth", "state")


def crawl_manifest(spark: SparkSession, d: str) -> DataFrame:
    return L.manifest(raw(spark, d), rebuilt_state(spark, d))


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap text per host, written from the records and read again."""
    rows = raw(spark, d).select(F.concat(F.lit("<urlset><url>\n <loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"), F.coalesce("fetched_at", F.lit("")), F.lit("</lastmod></url></urlset>")).alias("xml"))
    return sitemap_entries(rows)


def unseen(spark: SparkSession, d: str) -> DataFrame:
    return unseen_urls(_known(spark, d), _records(spark, d).where(F.col("url").isNotNull()))


QUERIES = {
    f.__name__: f
    for f in (
        store_stats, store_check, store_grep, page_hrefs, page_assets, link_assets, category_audit, rebuilt_state, fix_roots, verify_links, verify_corpus_links, all_links, subdomains, article_rows, listing_cards,
        fetch_candidates, filled_gaps, merged_state, sorted_articles, frontier_push, frontier_walk, visited_split, pagination, crawl_pacing, fetch_outcomes, recent_listing, recent_links, recent_queue, crawl_budget, crawl_manifest, sitemap_urls, unseen,
    )
}

# ---------------------------------------------------------------- SQL


def sql_key(u: str) -> str:
    return f"coalesce(case when regexp_matches({sql_path(u)}, '-\\d+\\.html$') then regexp_extract({sql_path(u)}, '([^/]*)$', 1) end, {u})"


def sql_kind(u: str) -> str:
    return f"case {sql_page(u, 'kind')} when regexp_matches({sql_path(u)}, '-\\d+\\.html$') then 'article' when ends_with({sql_path(u)}, '/') then 'listing' else 'other' end"


def _walk_sql() -> str:
    """Rounds of the walk, each behind what the rounds before it have queued."""
    edges = f"e as (select {sql_norm('src')} as src, dst from links)"
    parts = [f"q0 as (select distinct url, {sql_key('url')} as key, 0 as depth, 'seed' as via from (select {sql_norm('url')} as url from raw_pages where kind = 'listing') where url is not null)"]
    for d in range(1, L.MAX_DEPTH + 1):
        found = f"select {sql_norm('dst')} as url, {d} as depth, q.url as via, dst as ord from q{d - 1} q join e on e.src = q.url"
        best = f"select {sql_key('url')} as key, min((ord, url, via)) as m from ({found}) where url is not null and {sql_scope('url', HOME, True)} group by 1"
        known = " union all ".join(f"select key from q{k}" for k in range(d))
        parts.append(f"q{d} as (select m[2] as url, key, {d} as depth, m[3] as via from ({best}) where key not in ({known}))")
    return f"with {edges}, {', '.join(parts)} " + " union all ".join(f"select * from q{k}" for k in range(L.MAX_DEPTH + 1))


R = f"r as (select {sql_norm('url')} as url, html_b64, status, kind, fetched_at from raw_pages)"
K = f"k as (select url from (select {sql_norm('dst')} as url from links) where url is not null)"
FAMILY = f"({sql_host('url')} = '{HOME}' or ends_with({sql_host('url')}, '.{HOME}'))"
ART = f"nullif(regexp_extract({sql_path('url')}, '-(\\d+)\\.html$', 1), '')"
LISTED = f"l as (select *, {ART} as article_id from (select {sql_norm('url')} as url, coalesce(substring(fetched_at, 1, 10), '') as lastmod from raw_pages))"
STATE = f"with {R}, {K}, done as (select distinct url from r), dk as (select distinct {sql_key('url')} as key from done)"
SQL_STATE = STATE + f" select url, 'done' as state from done union all select url, case when {sql_key('url')} in (select key from dk where key is not null) then 'alias' else 'frontier' end from (select distinct url from k) x where not exists (select 1 from done where done.url = x.url)"
STEM = f"case {sql_page('url', 'stem')} end"
RECENT = (
    "with c0 as (select source as listing, row_number() over (partition by source order by doc_id) - 1 as pos, url, coalesce(strftime(fetched_at, '%Y-%m-%d'), '') as date from documents where source is not null), c as (select *, pos // 20 as page_no from c0),"
    " b as (select *, lag(date) over (partition by listing, page_no order by pos) as before from c where date <> ''), g as (select listing, page_no, coalesce(bool_and(before is null or date <= before), true) as mono, min(pos) filter (date < '2020-01-01') as old from b group by 1, 2),"
    " e as (select listing, min(page_no) as stop from g where mono and old is not null group by 1), m as (select c.* from c join g using (listing, page_no) left join e using (listing) where (e.stop is null or page_no <= e.stop) and date between '2020-01-01' and '2023-12-31' and (not (mono and old is not null) or pos < old))"
)
SQL = {
    "store_stats": "with f as (select * from raw_pages qualify row_number() over (partition by url order by store, shard, line_no, rec_id) = 1) select 'kind' as what, kind as value, count(*) as n from f group by kind union all select 'status', cast(status as varchar), count(*) from f group by status"
    " union all (select 'section', v, n from (select regexp_extract(url, '^https?://[^/]+/((?:(?:vi|en)/)?[^/?#]+)/', 1) as v, count(*) as n from f group by 1) where v <> '' order by n desc, v limit 30)"
    " union all select 'bytes', '', coalesce(sum(size), 0)::bigint from f union all select 'repeated', '', count(*) - count(distinct url) from raw_pages",
    "store_check": f"with {R}, {K}, kn as (select url, coalesce(bool_or(length(html_b64) > 0), false) as body from r where url is not null group by url), j as (select coalesce(d.url, kn.url) as url, d.url is not null as done, kn.url is not null as seen, coalesce(kn.body, false) as body from (select distinct url from k) d full join kn on kn.url = d.url)"
    f" select count(*) filter (done) as claimed, count(*) filter (done and seen) as present, count(*) filter (done and seen and not body) as no_body, count(*) filter (done and not seen and {sql_scope('url', HOME, True)}) as missing, count(*) filter (not done and seen) as stale from j",
    "store_grep": "select row_id, url from corpus where contains(lower(content), 'học bổng')",
    "link_assets": f"with {K} select {sql_ext('url')} as ext, count(distinct url) as n from k where {FAMILY} and regexp_matches({sql_path('url')}, '{U.ASSET}') group by 1",
    "category_audit": f"with {R}, {K}, e as (select distinct url from (select url from k union all select url from r)), g as (select distinct url from r),"
    f" x as (select url, regexp_replace(coalesce({STEM}, case when ends_with({sql_path('url')}, '/') then url end, regexp_extract(url, '^(.*/)', 1)), '\\?$', '') as category, case {sql_page('url', 'n')} end as n, url in (select url from g where url is not null) as got from e)"
    " select *, greatest(max_page - got_pages, 0) as missing from (select category, coalesce(max(n), 0) as max_page, count(*) filter (got and n is not null) as got_pages, coalesce(bool_or(got and url = category), false) as root_fetched,"
    " count(*) filter (got and regexp_matches(url, '-\\d+\\.html$')) as articles from x group by category) where max_page > 0 or articles > 0",
    "rebuilt_state": SQL_STATE,
    "fix_roots": f"with {R}, {K} select distinct root as url from (select regexp_replace(coalesce({STEM}, case when {sql_key('url')} <> url then regexp_extract(url, '^(.*/)', 1) end), '\\?$', '') as root from r) where root is not null and root not in (select url from r where url is not null) and root not in (select url from k)",
    "verify_corpus_links": f"with {K}, s as (select url from (select {sql_norm('l.url')} as url from (select unnest(outgoing_links) as l from corpus)) where url is not null) select distinct url, 'missing' as side from s where url not in (select url from k) union all select distinct url, 'extra' from k where url not in (select url from s)",
    "all_links": f"with {R}, {K} select distinct url, {sql_kind('url')} as kind from (select url from r union all select url from k union all select {sql_norm('url')} from corpus) where {FAMILY}",
    "subdomains": f"with {K} select {sql_host('url')} as host, count(*) as n from k where {FAMILY} group by 1",
    "fetch_candidates": f"with {LISTED}, m as (select article_id, max((lastmod, url)) as m from l where article_id is not null group by article_id), s as (select distinct article_id, lastmod from l where starts_with(url, 'https://tin.') and article_id is not null)"
    " select article_id, m[2] as url, m[1] as lastmod from m where m[1] >= '2020-01-01' and not exists (select 1 from s where s.article_id = m.article_id and s.lastmod = m.m[1]) order by m[1] desc, article_id limit 100",
    "filled_gaps": "with r as (select row_id, host, coalesce(section, '') as section from corpus), c as (select host, min(section) as s from r where section <> '' group by host) select row_id, r.host, coalesce(nullif(section, ''), c.s, '') as section from r left join c on c.host = r.host",
    "merged_state": f"with {LISTED} select article_id, max(lastmod) as lastmod from l where article_id is not null group by article_id",
    "sorted_articles": f"with {LISTED} select url, lastmod from l order by lastmod desc, url",
    "frontier_push": f"with f as (select * from (select {sql_norm('dst')} as url, src as via, link_id as ord from links) where url is not null and {sql_scope('url', HOME, True)}), q as (select {sql_key('url')} as key from (select {sql_norm('url')} as url from raw_pages) where url is not null),"
    f" m as (select {sql_key('url')} as key, arg_min(url, ord) as url, arg_min(via, ord) as via from f group by 1) select key, url, 1 as depth, via, {sql_kind('url')} = 'article' as front from m where key not in (select key from q)",
    "visited_split": f"with {K} select distinct url, case when regexp_matches({sql_path('url')}, '{U.ASSET}') then 'asset' else 'page' end as what from k where {FAMILY}",
    "pagination": f"with {R}, {K}, p as (select case {sql_page('url', 'template')} end as template, {STEM} as stem, case {sql_page('url', 'n')} end as n from (select url from r union all select url from k)), t as (select template, stem, max(n) as top from p where template is not null group by template, stem)"
    " select template, stem, n, replace(template, '{n}', cast(n as varchar)) as url from (select template, stem, unnest(range(2, least(top, 400) + 1)) as n from t where top >= 2)",
    "frontier_walk": _walk_sql(),
    "crawl_pacing": f"with r as (select {sql_host('url')} as host, rec_id, case when status = 503 then 429 else status end as status from raw_pages), l as (select host, list(rec_id order by rec_id) as ords, list(coalesce(status, 999) order by rec_id) as s from r group by host),"
    " f as (select host, ords, list_reduce(list_transform(s, lambda x: {'status': x, 'delay': 2.5::double, 'good': 0, 'out': []::double[]}), lambda a, x: case when x.status = 429 then {'status': 0, 'delay': least(a.delay * 1.5, 30.0::double), 'good': 0, 'out': list_append(a.out, least(a.delay * 1.5, 30.0::double))}"
    " when x.status < 400 and a.good = 24 then {'status': 0, 'delay': greatest(a.delay * 0.9, 2.5::double), 'good': 0, 'out': list_append(a.out, greatest(a.delay * 0.9, 2.5::double))}"
    " when x.status < 400 then {'status': 0, 'delay': a.delay, 'good': a.good + 1, 'out': list_append(a.out, a.delay)} else {'status': 0, 'delay': a.delay, 'good': a.good, 'out': list_append(a.out, a.delay)} end,"
    " {'status': 0, 'delay': 2.5::double, 'good': 0, 'out': []::double[]}) as f from l) select host, unnest(ords) as ord, unnest(f.out) as delay from f",
    "recent_listing": "with c as (select source as page_url, doc_id as pos, strftime(fetched_at, '%Y-%m-%d') as date from documents where source is not null and fetched_at is not null), w as (select *, lag(date) over (partition by page_url order by pos) as before from c)"
    " select *, monotonic and first_old is not null as stop from (select page_url, count(*) filter (date between '2020-01-01' and '2023-12-31') as matched, count(*) filter (date > '2023-12-31') as future, coalesce(bool_and(before is null or date <= before), true) as monotonic,"
    " min(pos) filter (date < '2020-01-01') as first_old from w group by page_url)",
    "fetch_outcomes": "with a as (select url, rec_id as ord, coalesce(status, 0) as s from raw_pages), b as (select *, (s > 0 and s < 400) or s in (403, 404, 410) as ok, s = 429 as slow from a), c as (select *, not ok and not slow as bad from b),"
    " d as (select *, sum(bad::int) over w as tries, sum(slow::int) over w as waits from c window w as (partition by url order by ord)), e as (select *, ok or tries >= 3 or waits >= 8 as over_ from d), f as (select *, sum(over_::int) over (partition by url order by ord) - over_::int as before from e)"
    " select url, count(*) as attempts, sum(case when bad then pow(2.0, tries) when slow then 30.0 else 0.0 end)::double as waited, case when bool_or(ok) then 'done' when max(tries) >= 3 or max(waits) >= 8 then 'given up' else 'open' end as outcome from f where before = 0 group by url",
    "recent_links": RECENT + " select listing, page_no, pos, url, date from m",
    "recent_queue": RECENT + f", w as (select url, max(date) as date from m group by url order by date desc, url limit 500), f as (select {sql_norm('url')} as u, date, url as raw from w), k as (select {sql_key('u')} as key, arg_min(u, (-date_diff('day', date '1900-01-01', date::date), raw)) as url from f where u is not null and {sql_scope('u', HOME, True)} group by 1)"
    f" select url, key, 1 as depth, 'recent' as via, true as front from k where key not in (select {sql_key('u')} from (select {sql_norm('url')} as u from raw_pages) where u is not null)",
    "crawl_budget": f"with q as ({_walk_sql()}) select url, depth, case when row_number() over (order by depth, ({sql_kind('url')} <> 'article')::int, url) <= 100 then 'done' else 'parked' end as state from q",
    "crawl_manifest": f"select 'kind:' || coalesce(kind, '') as what, count(*) as n from raw_pages group by 1 union all select 'state:' || state, count(*) from ({SQL_STATE}) group by 1",
    "sitemap_urls": "select url as loc, nullif(coalesce(fetched_at, ''), '') as lastmod, false as is_index from raw_pages where url is not null",
    "unseen": f"with {R}, {K} select distinct url from k where url not in (select url from r where url is not null)",
}
