"""Index and search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions.urls import file_type
from webloom.operators import index as I
from webloom.operators import search as S
from webloom.operators.pipeline import last_per_key
from webloom.plans.url_queries import SQL_BASE, sql_ext
from webloom.plans.session import forget, spread, stored, table

QUERY = "học bổng"
PHRASE = "chuẩn đầu ra ngoại ngữ"


def index_docs(spark: SparkSession, d: str) -> I.Index:
    return stored(spark, d, "index of documents", ["documents"], lambda: I.build(_documents(spark, d)))


def index_corpus(spark: SparkSession, d: str) -> I.Index:
    return stored(spark, d, "index of corpus", ["corpus"], lambda: I.build(_corpus(spark, d)))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as index documents; they have no title."""
    day = F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit(""))
    rows = spread(table(spark, d, "documents").drop("lang", "n_chars")).select(
        F.col("doc_id").alias("id"), "url", F.lit("").alias("title"), "text", F.col("source").alias("host"), "section", F.lit("").alias("author"), "kind",
        file_type(F.lit(None).cast("string"), F.col("kind"), F.col("url")).alias("ftype"), day.alias("date"),
    )
    return I.documents(rows)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """corpus as index documents, one for each URL: the last row sent."""
    every = table(spark, d, "corpus")
    last = every.groupBy("url").agg(F.max("row_id").alias("row_id")).select("row_id")
    rows = spread(every.drop("outgoing_links", "received_at")).join(last, "row_id", "left_semi").select(
        F.col("row_id").alias("id"), "url", "title", F.col("content").alias("text"), "host", "section", "author", "kind", F.lit("html").alias("ftype"),
        T.date_or_empty(F.col("published_at")).alias("date"),
    )
    return I.documents(rows)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The index of documents, built anew for the searches that follow: its stored fields."""
    forget(spark, d, "index of documents", ["documents"])
    docs = index_docs(spark, d).docs
    return docs.select("id", "url", "host", "section", "kind", "ftype", "date", "date_num", F.col("sizes")[I.ANALYSED.index("text_kd")].cast("bigint").alias("n_tokens"))


def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return I.dictionary(index_docs(spark, d), "text_kd", "hoc", 200)


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.dictionary(index_docs(spark, d), "text")


def field_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.field_stats(index_docs(spark, d), ["title", "text", "section", "text_kd"])


def posting_list(spark: SparkSession, d: str) -> DataFrame:
    return I.posting_list(index_docs(spark, d), "text_kd", "hoc", 100).select("id", F.col("tf").cast("bigint").alias("tf"), F.array_join("positions", ",").alias("positions"), "doc_freq", "total_freq")


def postings(spark: SparkSession, d: str) -> DataFrame:
    """All postings of the folded text, summed per term, with a sum over positions."""
    p = index_docs(spark, d).postings.where("field = 'text_kd'")
    return p.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_freq"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("position_sum"))


def _found(spark: SparkSession, d: str, p: S.SearchParams, index: I.Index | None = None) -> DataFrame:
    return S.ranked(index or index_docs(spark, d), p).select("id", "url", F.round("score", 6).alias("score"))


def search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, S.SearchParams(QUERY, "tfidf"))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, S.SearchParams(QUERY, "tfidf", kind="page", date_from="2020-01-01", date_to="2023-12-31"))


def search_by_date(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(index_docs(spark, d), S.SearchParams(QUERY, "tfidf", sort="date")).select("id", "url", "date_num")


def search_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """No document has all words; those with at least half of them come."""
    return _found(spark, d, S.SearchParams("hoc zzqx1 bong zzqx2", "tfidf"))


def search_enhanced(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, S.SearchParams(QUERY), index_corpus(spark, d))


def search_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Phrase, field, exclusion and prefix."""
    index = index_docs(spark, d)
    found = S.matching(index, S.parse_query(f'text:"{PHRASE}" -text:"lịch thi" text:nghiên*'), {"text": 1.0})
    return index.docs.select("id", "url").join(found, "id", "left_semi")


def search_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A fuzzy word, a wildcard inside a word and a range of words, by the dictionary's terms."""
    index = index_docs(spark, d)
    found = S.matching(index, S.parse_query("text_kd:truongg~1 text_kd:th?ng text_kd:[hoc TO hoi}"), {"text_kd": 1.0})
    return index.docs.select("id", "url").join(found, "id", "left_semi")


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of results with merged near-duplicates and snippets, and the total of hits beside each row."""
    found = S.search(index_corpus(spark, d), S.SearchParams(QUERY, size=20))
    return found.page.withColumn("total", F.lit(found.total).cast("bigint"))


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many documents a query hits, and how many are listed under a filter: what pages are counted from."""
    index = index_docs(spark, d)
    rows = [("hits", S.hits(index, S.SearchParams(QUERY, "tfidf")).count()), ("listed", S.list_page(index, kind="document", size=1).total)]
    return spark.createDataFrame(rows, "what string, total bigint")


def list_all(spark: SparkSession, d: str) -> DataFrame:
    return I.list_documents(index_docs(spark, d)).select("id", "url", "date_num")


def list_by_url(spark: SparkSession, d: str) -> DataFrame:
    return I.list_documents(index_docs(spark, d), kind="document", by_url=True).select("id", "url", "date_num")


def list_merged(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest documents, near-duplicates merged."""
    return S.list_page(index_docs(spark, d), size=100).page


def documents_by_host(spark: SparkSession, d: str) -> DataFrame:
    return index_docs(spark, d).docs.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def upsert_by_url(spark: SparkSession, d: str) -> DataFrame:
    """The last row sent of each URL: what writing the corpus again and again leaves."""
    rows = table(spark, d, "corpus").select(F.col("row_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"))
    return last_per_key(rows, "url", ["id"])


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One document by its URL, the smallest one of the corpus."""
    url = table(spark, d, "corpus").agg(F.min("url")).first()[0] or ""
    return I.get_document(index_corpus(spark, d), url).select("id", "url", "title")


QUERIES = {
    f.__name__: f
    for f in (index_build, term_dictionary, term_counts, field_stats, posting_list, postings, search_tfidf, search_filtered, search_by_date, search_relaxed, search_enhanced, search_grammar, search_patterns, search_page, search_totals, list_all, list_by_url, list_merged, documents_by_host, upsert_by_url, point_lookup)
}

# ---------------------------------------------------------------- SQL

TOK = T.TOKEN


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOK}')"


FOLD = "translate(strip_accents(coalesce(text, '')), 'đĐ', 'dD')"
DAY = "coalesce(strftime(fetched_at, '%Y-%m-%d'), '')"
NUM = f"cast(coalesce(try_cast(replace(nullif({DAY}, ''), '-', '') as bigint), 0) as bigint)"
D = f"(select doc_id as id, url, coalesce(source, '') as host, coalesce(kind, '') as kind, {NUM} as date_num, {tok(FOLD)} as w from documents)"


def n_of(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def sql_search(words: list[str], where: str = "true", least: int | None = None) -> str:
    columns = ", ".join(f"{n_of(x)} as c{i}" for i, x in enumerate(words))
    stats = ", ".join(f"count(*) filter (c{i} > 0) as d{i}" for i in range(len(words)))
    score = " + ".join(f"(case when c{i} > 0 then (1 + ln((n + 1)::double / (d{i} + 1))) * sqrt(c{i}) / sqrt(greatest(len(w), 1)) else 0 end)" for i in range(len(words)))
    match = " and ".join(f"c{i} > 0" for i in range(len(words))) if least is None else " + ".join(f"(c{i} > 0)::int" for i in range(len(words))) + f" >= {least}"
    return f"with f as (select *, {columns} from {D}), s as (select count(*) as n, {stats} from f) select id, url, round(sc, 6) as score from (select id, url, {score} as sc from f, s where {match} and {where} order by sc desc, url, id limit 50)"


def sql_enhanced(a: str, b: str) -> str:
    """The enhanced ranking of a query of two words over corpus, for any accented words: fields, phrases and what a document is worth."""
    fold = lambda x: f"translate(strip_accents(coalesce({x}, '')), 'đĐ', 'dD')"
    fields = {"title": tok("title"), "section": tok("section"), "text": tok("text"), "title_kd": tok(fold("title")), "text_kd": tok(fold("text"))}
    words = {f: [S.fold_python(w) for w in (a, b)] if f.endswith("_kd") else [a, b] for f in fields}
    tf = ", ".join(f"len(list_filter({f}, lambda x: x = '{w}')) as {f}{i}" for f in fields for i, w in enumerate(words[f]))
    places = lambda f, i: f"list_filter(list_transform({f}, lambda x, k: case when x = '{words[f][i]}' then k end), lambda k: k is not null)"
    span = lambda slop: f"list_slice({{f}}, greatest(k + 1 - {slop}, 1), greatest(k + 1 - {slop}, 1) + {2 * slop})"
    phrases = {f: f"len(list_filter({places(f, 0)}, lambda k: list_contains({span(slop).format(f=f)}, '{words[f][1]}')))" for f, slop, _ in S.PHRASES}
    counted = ", ".join(f"{p} as {f}_p" for f, p in phrases.items())
    df = ", ".join(f"count(*) filter ({f}{i} > 0) as d_{f}{i}" for f in fields for i in (0, 1))
    idf = lambda f, i: f"(1 + ln((n + 1)::double / (d_{f}{i} + 1)))"
    one = lambda f, i, boost: f"{boost} * {idf(f, i)} * sqrt({f}{i}) / sqrt(greatest(len({f}), 1))"
    branch = lambda boosts: (" and ".join("(" + " or ".join(f"{f}{i} > 0" for f in boosts) + ")" for i in (0, 1)), " + ".join(one(f, i, w) for f, w in boosts.items() for i in (0, 1)))
    (m1, s1), (m2, s2) = branch(S.ACCENTED), branch(S.FOLDED)
    extra = " + ".join(f"{boost} * ({idf(f, 0)} + {idf(f, 1)}) * sqrt({f}_p) / sqrt(greatest(len({f}), 1))" for f, _, boost in S.PHRASES)
    base = SQL_BASE.replace("year(fetched_at) between 1990 and 2027", "y between 1990 and 2027").replace("year(fetched_at)", "y")
    arrays = ", ".join(f"{x} as {f}" for f, x in fields.items())
    rows = "select row_id as id, coalesce(url, '') as url, coalesce(title, '') as title_, coalesce(content, '') as text_, section as section_, case when coalesce(regexp_matches(substring(published_at, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') and try_cast(substring(published_at, 1, 10) as date) is not null, false) then substring(published_at, 1, 4)::int end as y from corpus qualify row_number() over (partition by url order by row_id desc) = 1"
    return (
        f"with c as ({rows}), a as (select id, url, y, text_, {arrays} from (select id, url, y, text_, title_ as title, text_ as text, section_ as section from c)), f as (select *, {tf} from a), s as (select count(*) as n, {df} from f),"
        f" r as (select id, url, y, text_ as text, (case when {m1} then {s1} else 0 end) + (case when {m2} then {s2} else 0 end) + {extra} as sc from (select *, {counted} from f), s where ({m1}) or ({m2}) order by sc desc, url, id limit 50)"
        f" select id, url, round(sc * {base}, 6) as score from r"
    )


E = "(select id, url, {0} as w from (select doc_id as id, url, text, section from documents))"
SQL = {
    "index_build": f"select doc_id as id, coalesce(url, '') as url, coalesce(source, '') as host, coalesce(section, '') as section, coalesce(kind, '') as kind, case when kind = 'page' then 'html' when {sql_ext('url')} <> '' then {sql_ext('url')} else 'khac' end as ftype, {DAY} as date, {NUM} as date_num, len({tok(FOLD)}) as n_tokens from documents",
    "term_dictionary": f"select 'text_kd' as field, term, doc_freq, total_freq from (select term, count(distinct id) as doc_freq, cast(count(*) as bigint) as total_freq from (select id, unnest(w) as term from {D}) group by term) where encode(term) >= encode('hoc') order by encode(term) limit 200",
    "term_counts": f"select 'text' as field, term, count(distinct id) as doc_freq, count(*) as total_freq from (select doc_id as id, unnest({tok('text')}) as term from documents) group by term",
    "field_stats": f"select 'title' as field, 0 as docs, 0 as tokens union all select 'text', count(*) filter (len({tok('text')}) > 0), sum(len({tok('text')}))::bigint from documents union all select 'section', count(*) filter (len({tok('section')}) > 0), sum(len({tok('section')}))::bigint from documents"
    f" union all select 'text_kd', count(*) filter (len({tok(FOLD)}) > 0), sum(len({tok(FOLD)}))::bigint from documents",
    "posting_list": f"with p as (select id, list_filter(list_transform(w, lambda x, i: case when x = 'hoc' then i - 1 end), lambda x: x is not null) as pos from {D}), q as (select * from p where len(pos) > 0), t as (select count(*) as doc_freq, sum(len(pos))::bigint as total_freq from q)"
    " select id, len(pos) as tf, array_to_string(pos, ',') as positions, doc_freq, total_freq from q, t order by len(pos) desc, id limit 100",
    "postings": f"select 'text_kd' as field, term, count(distinct id) as doc_freq, count(*) as total_freq, sum(pos)::bigint as position_sum from (select id, unnest(w) as term, unnest(range(len(w))) as pos from {D}) group by term",
    "search_tfidf": sql_search(["hoc", "bong"]),
    "search_filtered": sql_search(["hoc", "bong"], "kind = 'page' and date_num between 20200101 and 20231231"),
    "search_by_date": f"select id, url, date_num from {D} where {n_of('hoc')} > 0 and {n_of('bong')} > 0 order by date_num desc, url, id limit 50",
    "search_enhanced": sql_enhanced("học", "bổng"),
    "search_patterns": f"select id, url from {D} where len(list_filter(w, lambda x: levenshtein(x, 'truongg') <= 1)) > 0 and len(list_filter(w, lambda x: regexp_full_match(x, 'th.ng'))) > 0 and len(list_filter(w, lambda x: x >= 'hoc' and x < 'hoi')) > 0",
    "search_totals": f"select 'hits' as what, count(*) as total from {D} where {n_of('hoc')} > 0 and {n_of('bong')} > 0 union all select 'listed', count(*) from documents where kind = 'document'",
    "search_relaxed": sql_search(["hoc", "zzqx1", "bong", "zzqx2"], least=2),
    "search_grammar": "with x as (select doc_id as id, url, ' ' || array_to_string(" + tok("text") + f", ' ') || ' ' as t from documents) select id, url from x where contains(t, ' {PHRASE} ') and not contains(t, ' lịch thi ') and contains(t, ' nghiên')",
    "list_all": f"select id, url, date_num from {D} order by date_num desc, url, id limit 200",
    "list_by_url": f"select id, url, date_num from {D} where kind = 'document' order by url, id limit 200",
    "documents_by_host": "select coalesce(source, '') as host, count(*) as n from documents group by 1",
    "upsert_by_url": "select row_id as id, coalesce(url, '') as url, coalesce(title, '') as title from corpus qualify row_number() over (partition by url order by row_id desc) = 1",
    "point_lookup": "select row_id as id, coalesce(url, '') as url, coalesce(title, '') as title from corpus qualify row_number() over (partition by url order by row_id desc) = 1 order by url limit 1",
}
