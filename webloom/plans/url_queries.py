"""URL and scalar function queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.simhash import near_pairs, simhash
from webloom.plans.session import spread, table

HOME = "bachlam.example"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_pages").select("rec_id", "url")


def url_norm(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("rec_id", U.normalized(F.col("url")).alias("norm"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select(
        "rec_id", U.hostname(u).alias("host"), U.path_of(u).alias("path"), U.path_query(u).alias("path_query"), U.after_host(u).alias("after_host"),
        U.scheme(u).alias("scheme"), U.is_full_http(u).alias("full_http"),
    )


def url_kind(spark: SparkSession, d: str) -> DataFrame:
    u = U.normalized(F.col("url"))
    p = U.page_of(u)
    return pages(spark, d).select(
        "rec_id", U.kind_of(u).alias("kind"), U.dedup_key(u).alias("dedup_key"), U.art_id(u).alias("art_id"), U.lang_of(u).alias("lang"),
        p["template"].alias("page_template"), p["n"].alias("page_n"), p["stem"].alias("page_stem"),
    )


def url_scope(spark: SparkSession, d: str) -> DataFrame:
    u = U.normalized(F.col("dst"))
    links = table(spark, d, "links").select("dst").distinct()
    return links.select(
        "dst", U.in_scope(u, "tin." + HOME).alias("in_scope"), U.in_scope(u, HOME, suffix=True).alias("in_family_scope"), U.dest_kind(u, HOME).alias("dest_kind"),
        U.extension(u).alias("ext"),
    )


def url_types(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files_ok")
    return files.select(
        "file_id", U.file_type(F.col("ext"), F.lit("document"), F.col("url")).alias("file_type"), U.file_type(F.lit(None).cast("string"), F.lit("page"), F.col("url")).alias("page_file_type"),
        U.classify_content(F.col("mime"), F.col("url")).alias("content_class"),
    )


def url_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Relative links against their page, by Python's rules."""
    return table(spark, d, "links").select("link_id", U.resolved(F.concat(F.lit("../x/./"), F.regexp_extract("dst", "([^/]*)$", 1)), F.col("src")).alias("target"))


def url_encoded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("link_id", U.encoded(F.concat("dst", F.lit("?q="), "text")).alias("uri"), U.unquoted(F.col("dst")).alias("plain"))


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    rules = "User-agent: *\nDisallow: /hop-tac/\nAllow: /\n\nUser-agent: webloom\nAllow: /hop-tac/\nDisallow: /viec-lam/\n"
    return pages(spark, d).select("rec_id", U.can_fetch(F.lit(rules), F.lit("webloom/1.0"), F.col("url")).alias("mine"), U.can_fetch(F.lit(rules), F.lit("other"), F.col("url")).alias("others"))


def text_fold(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "section")).select("doc_id", F.sha1(T.fold(F.col("text"))).alias("folded_sha1"), T.fold(F.col("section")).alias("section_folded"))


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.word_count(t).cast("bigint").alias("words"), F.length(t).cast("bigint").alias("chars"), T.head(t, 60).alias("head"), T.tail(t, 60).alias("tail"),
        F.sha1(T.clean_space(t)).alias("clean_sha1"), T.sha1_key(F.col("source"), F.col("section")).alias("key"),
    )


def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of every whole text."""
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("published_at")
    return table(spark, d, "corpus").select(
        "row_id", T.normalize_date(p).alias("date"), T.date_num(T.normalize_date(p)).alias("date_num"), T.parse_date_vn(p).alias("date_vn"), T.is_valid_date(p).alias("valid"),
        T.date_or_empty(p).alias("date_or_empty"), T.vn_datetime(p).alias("vn_datetime"),
    )


def suspect_encoding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files_ok").select("file_id", T.suspect_encoding(F.col("text")).alias("suspect"))


def base_score(spark: SparkSession, d: str) -> DataFrame:
    day = F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.round(T.base_score(F.col("url"), F.length("text"), day, 2026), 6).alias("base_score"))


def simhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", simhash(F.lit(""), F.col("text")).alias("sig"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Texts within three bits of SimHash: one link a class member, all links between classes."""
    return near_pairs(simhash_signature(spark, d), "doc_id", "sig")


QUERIES = {
    f.__name__: f
    for f in (url_norm, url_parts, url_kind, url_scope, url_types, url_resolved, url_encoded, robots_allowed, text_fold, text_measures, text_fingerprints, text_dates, suspect_encoding, base_score, simhash_signature, near_dup_pairs)
}

# ---------------------------------------------------------------- SQL

WS = r"[\s\x1c-\x1f\p{Z}\x{0085}]"


def sql_path(u: str) -> str:
    return rf"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def sql_query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def sql_netloc(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def sql_host(u: str) -> str:
    return rf"lower(regexp_extract(regexp_replace({sql_netloc(u)}, '^.*@', ''), '^([^:]*)', 1))"


def sql_norm(u: str) -> str:
    kept = f"array_to_string(list_filter(string_split({sql_query(u)}, '&'), lambda p: p <> '' and regexp_extract(p, '^([^=]*)', 1) not in {U.TRACKING}), '&')"
    return (
        f"case when regexp_matches({u}, '(?i)^https?://[^/?#]') then 'https://' || replace(lower({sql_netloc(u)}), 'www.', '') || regexp_replace({sql_path(u)}, '//+', '/', 'g')"
        f" || case when {kept} <> '' then '?' || {kept} else '' end end"
    )


def sql_ext(u: str) -> str:
    return rf"lower(regexp_extract({sql_path(u)}, '\.([A-Za-z0-9]{{1,8}})$', 1))"


def sql_page(u: str, what: str) -> str:
    cases = []
    for pattern, rest in U.PAGE_FORMS:
        value = {"template": f"regexp_extract({u}, '{pattern}', 1) || '{rest}'", "n": f"cast(regexp_extract({u}, '{pattern}', 2) as bigint)", "stem": f"regexp_extract({u}, '{pattern}', 1)", "kind": "'listing-page'"}[what]
        cases.append(f"when regexp_matches({u}, '{pattern}') then {value}")
    return " ".join(cases)


def sql_scope(u: str, home: str, suffix: bool) -> str:
    host = sql_host(u)
    ok = f"({host} = '{home}' or ends_with({host}, '.{home}'))" if suffix else f"{host} = '{home}'"
    skip = " and ".join(f"not starts_with({sql_path(u)}, '{p}')" for p in U.SKIP_PREFIX)
    return f"coalesce({ok} and {skip} and not regexp_matches({sql_path(u)}, '{U.ASSET}') and not regexp_matches({sql_path(u)}, '{U.SKIP_SEGMENT}') and not regexp_matches({sql_query(u)}, '{U.SKIP_QUERY}'), false)"


def sql_dest(u: str) -> str:
    return (
        f"case when {u} is null then 'page' when not ({sql_host(u)} = '{HOME}' or ends_with({sql_host(u)}, '.{HOME}')) then 'external' when {sql_ext(u)} in {U.DOCUMENT_EXT} or contains({sql_query(u)}, 'download=1') then 'document'"
        f" when {sql_ext(u)} in {U.IMAGE_EXT} then 'image' else 'page' end"
    )


def sql_valid(y: str, m: str, d: str) -> str:
    made = f"({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'))"
    return f"case when try_cast({made} as date) is not null then {made} else '' end"


VN = r"(?:^|\D)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?:\D|$)"
ISO = r"^\s*(\d{4})-(\d{2})-(\d{2})"
VNT = r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\D{1,3}(\d{1,2}):(\d{2}))?"
_g = lambda p, k: f"regexp_extract(published_at, '{p}', {k})"
SQL_VN = f"case when regexp_matches(published_at, '{VN}') then {sql_valid(_g(VN, 3), _g(VN, 2), _g(VN, 1))} else '' end"
SQL_DATE = f"case when regexp_matches(published_at, '{ISO}') then {sql_valid(_g(ISO, 1), _g(ISO, 2), _g(ISO, 3))} else {SQL_VN} end"
SQL_VALID = r"coalesce(regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}$') and try_cast(published_at as date) is not null, false)"
SQL_BASE = (
    "(case when coalesce(url, '') = '' then 1.0 when contains(lower(url), '/page-') or contains(lower(url), '/page/') then 0.5 when ends_with(lower(url), '.html') or ends_with(lower(url), '.htm') then 1.0"
    " when ends_with(lower(url), '/') then 0.7 else 0.9 end)::double * (0.75 + 0.25 * least(1.0, length(text) / 1200.0::double)) * (case when year(fetched_at) between 1990 and 2027"
    " then 0.92 + 0.16 * exp(-greatest(0, 2026 - year(fetched_at)) / 3.0::double) else 1.0 end)"
)
CLEAN = rf"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
N = "(select rec_id, regexp_replace(url, '^\\s+|\\s+$', '', 'g') as u0, url from raw_pages)"
NORMED = f"(select rec_id, {sql_norm('u0')} as u from {N})"



def sql_quote(x: str) -> str:
    """Percent-encoding of what a URI doesn't allow."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: case when regexp_matches(c, '[A-Za-z0-9%:/?#@!$&()*+,;=~._''\\[\\]-]') then c else regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') end), '')"


# FNV-1a over runs of three folded words, then the majority of every bit; 64-bit products need 128 bits
SHINGLED = "regexp_split_to_array(lower(translate(strip_accents(' ' || coalesce(text, '')), 'đĐ', 'dD')), '[^a-z0-9]+')"
FNV = "list_reduce(list_transform(range(1, length(x) + 1), lambda i: ascii(x[i])::hugeint), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::hugeint)"
SIGNATURES = (
    f"with w as (select doc_id, {SHINGLED} as w from documents), t as (select doc_id, case when w[-1] = '' then w[:-2] else w end as w from w),"
    " s as (select doc_id, list_filter(list_transform(range(1, len(w) - 1), lambda i: case when w[i] <> '' then array_to_string(w[i:i + 2], ' ') end), lambda x: x is not null) as s from t),"
    f" h as (select doc_id, {FNV} as h from (select doc_id, unnest(s) as x from s where len(s) >= 100)), n as (select doc_id, count(*) as n, [" + ", ".join(f"sum((h >> {b}) & 1)" for b in range(64)) + "] as ones from h group by doc_id),"
    " v as (select doc_id, list_sum(list_transform(range(1, 65), lambda i: case when 2 * ones[i] > n then 1::hugeint << (i - 1)::int else 0::hugeint end))::hugeint as v from n),"
    " g as (select d.doc_id, coalesce(case when v >= 9223372036854775808 then v - 18446744073709551616 else v end, 0)::bigint as sig from documents d left join v using (doc_id))"
)

SQL = {
    "url_norm": f"select rec_id, u as norm from {NORMED}",
    "url_parts": f"select rec_id, {sql_host('url')} as host, {sql_path('url')} as path, {sql_path('url')} || case when {sql_query('url')} <> '' then '?' || {sql_query('url')} else '' end as path_query,"
    rf" regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) as after_host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, coalesce(regexp_matches(url, '(?i)^https?://[^/?#\s]+'), false) as full_http from raw_pages",
    "url_kind": f"select rec_id, case {sql_page('u', 'kind')} when regexp_matches({sql_path('u')}, '-\\d+\\.html$') then 'article' when ends_with({sql_path('u')}, '/') then 'listing' else 'other' end as kind,"
    f" case when regexp_matches({sql_path('u')}, '-\\d+\\.html$') then regexp_extract({sql_path('u')}, '([^/]*)$', 1) end as dedup_key, nullif(regexp_extract({sql_path('u')}, '-(\\d+)\\.html$', 1), '') as art_id,"
    f" case when starts_with({sql_path('u')}, '/en/') then 'en' else 'vi' end as lang, case {sql_page('u', 'template')} end as page_template, case {sql_page('u', 'n')} end as page_n, case {sql_page('u', 'stem')} end as page_stem from {NORMED}",
    "url_scope": f"select dst, {sql_scope('u', 'tin.' + HOME, False)} as in_scope, {sql_scope('u', HOME, True)} as in_family_scope, {sql_dest('u')} as dest_kind, {sql_ext('u')} as ext"
    f" from (select distinct dst, {sql_norm('dst')} as u from links)",
    "url_types": f"select file_id, case when coalesce(ext, '') <> '' then lower(ext) when {sql_ext('url')} <> '' then {sql_ext('url')} else 'khac' end as file_type, 'html' as page_file_type,"
    f" case when contains(lower(coalesce(mime, '')), 'html') then 'html' when regexp_matches(lower(coalesce(mime, '')), 'pdf|msword|officedocument|ms-excel|ms-powerpoint|openxmlformats') or {sql_ext('url')} in {U.DOCUMENT_EXT} then 'document'"
    f" when starts_with(lower(coalesce(mime, '')), 'image/') or {sql_ext('url')} in {U.IMAGE_EXT} then 'image' else 'other' end as content_class from files_ok",
    "text_fold": "select doc_id, sha1(translate(strip_accents(text), 'đĐ', 'dD')) as folded_sha1, translate(strip_accents(section), 'đĐ', 'dD') as section_folded from documents",
    "text_measures": f"select doc_id, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) as bigint) as words, length(text) as chars, substring(text, 1, 60) as head, right(text, 60) as tail,"
    f" sha1({CLEAN}) as clean_sha1, sha1(concat_ws('|', source, section)) as key from documents",
    "text_fingerprints": f"select doc_id, substring(sha1(regexp_replace(lower({CLEAN}), '\\p{{Nd}}+', '0', 'g')), 1, 16) as fingerprint from documents",
    "text_dates": f"select row_id, coalesce({SQL_DATE}, '') as date, cast(coalesce(try_cast(replace(nullif({SQL_DATE}, ''), '-', '') as bigint), 0) as bigint) as date_num, coalesce({SQL_VN}, '') as date_vn, {SQL_VALID} as valid,"
    " case when coalesce(regexp_matches(substring(published_at, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') and try_cast(substring(published_at, 1, 10) as date) is not null, false) then substring(published_at, 1, 10) else '' end as date_or_empty,"
    f" case when regexp_matches(published_at, '{VNT}') and {sql_valid(_g(VNT, 3), _g(VNT, 2), _g(VNT, 1))} <> '' then {sql_valid(_g(VNT, 3), _g(VNT, 2), _g(VNT, 1))}"
    f" || case when {_g(VNT, 4)} <> '' then 'T' || lpad({_g(VNT, 4)}, 2, '0') || ':' || {_g(VNT, 5)} || ':00' else '' end end as vn_datetime from corpus",
    "suspect_encoding": "select file_id, coalesce(length(text) >= 200 and length(text) - length(regexp_replace(text, '[¡-ÿ]', '', 'g')) > 0.04 * length(text)"
    " and length(text) - length(regexp_replace(text, '[ăđơưĂĐƠƯẠ-ỹ]', '', 'g')) < 0.005 * length(text), false) as suspect from files_ok",
    "url_resolved": f"select link_id, {sql_norm('t')} as target from (select link_id, regexp_extract(u, '^(https?://[^/?#]*)', 1) || regexp_replace(regexp_extract(regexp_replace(u, '[?#].*$', ''), '^https?://[^/]*(/.*/|/)[^/]*$', 1), '[^/]+/$', '') || 'x/' || regexp_extract(dst, '([^/]*)$', 1) as t"
    " from (select link_id, dst, src as u from links))",
    "url_encoded": f"select link_id, {sql_quote("(dst || '?q=' || text)")} as uri, url_decode(dst) as plain from links",
    "robots_allowed": f"select rec_id, case when starts_with(p, '/hop-tac/') then true else not starts_with(p, '/viec-lam/') end as mine, not starts_with(p, '/hop-tac/') as others from (select rec_id, {sql_path('url')} as p from raw_pages)",
    "simhash_signature": SIGNATURES + " select doc_id, sig from g",
    "near_dup_pairs": SIGNATURES + ", c as (select sig, min(doc_id) as rep from g where sig <> 0 group by sig) select a.rep as key_a, b.rep as key_b, bit_count(xor(a.sig, b.sig))::int as bits from c a join c b on a.rep < b.rep and bit_count(xor(a.sig, b.sig)) <= 3"
    " union all select c.rep, g.doc_id, 0 from g join c using (sig) where g.doc_id <> c.rep",
    "base_score": f"select doc_id, round({SQL_BASE}, 6) as base_score from documents",
}
