"""Queries of this subpackage, by problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import encodings, leakage, lines, lookalike, mainbody, neardup, packing, spam
from webloom.plans.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents that hold characters which only look like the usual ones."""
    return lookalike.find_lookalikes(table(spark, sf_dir, "corpus"), "row_id", ["title", "content"])


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and content in the consistent form."""
    return lookalike.normalize_columns(table(spark, sf_dir, "corpus"), "row_id", ["title", "content"])


def _pair_scores(spark: SparkSession, sf_dir: str):
    return encodings.model(table(spark, sf_dir, "corpus"), ["title", "content"])


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = _pair_scores(spark, sf_dir)
    files = encodings.garbled_texts(table(spark, sf_dir, "files_ok"), "file_id", "text", score)
    pages = encodings.garbled_pages(table(spark, sf_dir, "raw_pages"), "rec_id", score)
    return files.select(F.lit("files_ok").alias("tbl"), F.col("file_id").alias("row_key"), "restored", "causes").unionByName(
        pages.select(F.lit("raw_pages").alias("tbl"), F.col("rec_id").alias("row_key"), "restored", "causes")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text isn't what was written, and pages that their declared encoding doesn't read as they were written."""
    return _garbled(spark, sf_dir).select("tbl", "row_key")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with their text restored where possible, and what had happened to it."""
    return _garbled(spark, sf_dir).select("tbl", "row_key", "restored", F.array_join("causes", "; ").alias("causes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a line that many rows of its host hold."""
    return lines.repeated_lines(table(spark, sf_dir, "corpus"), "row_id", "content", "host", "url").select(F.col("id").alias("row_id"), "line_no")


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line templates that cover many rows of a host."""
    return lines.templates(table(spark, sf_dir, "corpus"), "row_id", "content", "host", "url")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content without its repeated lines."""
    return lines.remove_lines(table(spark, sf_dir, "corpus"), "row_id", "content", "host", "url")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of corpus rows whose sets of three consecutive words have at least 0.70 of their union in common."""
    pairs = neardup.duplicate_pairs(table(spark, sf_dir, "corpus"), "row_id", "content", words=3, threshold=0.7)
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus row with five words or more, its class of equal shingle sets, and the class's number of links at 0.8."""
    links, members = neardup.near_duplicates(table(spark, sf_dir, "corpus"), "row_id", "content")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(degree, "rep", "left").select(F.col("id").alias("row_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _page_bodies(spark: SparkSession, sf_dir: str, wanted: Column | None = None) -> DataFrame:
    """Main body of every (wanted) page that its declared encoding reads as it was written."""
    return mainbody.page_main_body(table(spark, sf_dir, "raw_pages"), "rec_id", "url", _pair_scores(spark, sf_dir), wanted)


def _text_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.text_main_body(table(spark, sf_dir, "corpus"), "row_id", "content", "title", "host", "url")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main body of corpus rows, by line, and of article pages, by piece."""
    pieces = _page_bodies(spark, sf_dir, F.coalesce((F.col("kind") == "article") & (F.col("status") < 400), F.lit(False)))
    rows = _text_bodies(spark, sf_dir).select(F.lit("corpus").alias("tbl"), F.col("row_id").alias("row_key"), F.col("line_no").cast("string").alias("par_key"))
    return rows.unionByName(pieces.select(F.lit("raw_pages").alias("tbl"), F.col("rec_id").alias("row_key"), F.md5(F.encode("text", "UTF-8")).alias("par_key")))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main body of every page, as one text."""
    parts = _page_bodies(spark, sf_dir).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "text"))).alias("parts"))
    return parts.select("rec_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in containers of each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"), "doc_id", "text")


def p7_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.occupancy(p7_containers(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assignment must hold to: no container overfull, no text split in vain, each token once."""
    documents, containers = table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")
    return packing.violations(p7_containers(spark, sf_dir), containers, documents, "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 15 consecutive words of a test item."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")
    return leaks.where(F.col("exact") > 0).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All template windows shared with test items, and how many of them are exact or re-parameterised."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly repeated keywords, link lists or tags."""
    return spam.find_spam(table(spark, sf_dir, "documents"), "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shares of links, tags and stuffed pieces."""
    return spam.measure_pages(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_normalized": p1_normalized, "p2_found": p2_found, "p2_restored": p2_restored,
    "p4_found": p4_found, "p4_templates": p4_templates, "p4_cleaned": p4_cleaned,
    "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p6_bodies": p6_bodies, "p7_containers": p7_containers, "p7_occupancy": p7_occupancy, "p7_invariants": p7_invariants,
    "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_shares": p9_shares,
}
# ---------------------------------------------------------------- SQL

_WS = r"[\s\x1c-\x1f\p{Z}\x{0085}]"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '^www\.', '')"
_ROWS = f"r as (select row_id, case when host is null or trim(host) = '' or host <> lower(host) then coalesce({_HOST}, '') else host end as host, content from corpus where length(content) > 0)"
_FOLDED = r"regexp_extract_all(translate(strip_accents(lower(text)), 'đ', 'd'), '[\p{L}\p{N}]+')"


def _windows(words: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"


_LINES = (
    f"with {_ROWS}, l as (select row_id, host, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as line_no from r),"
    f" f as (select row_id, host, line, line_no, regexp_replace(lower(trim(regexp_replace(line, '{_WS}+', ' ', 'g'))), '\\p{{Nd}}+', '0', 'g') as form from l),"
    " n as (select host, greatest(6, round(count(*) * 0.1, 6)) as least from r group by host)"
)
_REPEATED = ", c as (select host, form from f join n using (host) where form <> '' group by host, form, least having count(distinct row_id) >= least)"

SQL: dict[str, str] = {
    "p4_found": _LINES + _REPEATED + " select row_id, line_no from f join c using (host, form)",
    "p4_cleaned": _LINES + _REPEATED + ", k as (select row_id, string_agg(line, chr(10) order by line_no) as kept, count(*) as n from f where not exists (select 1 from c where c.host = f.host and c.form = f.form) group by row_id),"
    " g as (select row_id from f join c using (host, form) group by row_id) select t.row_id, case when g.row_id is null then t.content else coalesce(k.kept, '') end as content from corpus t left join g using (row_id) left join k using (row_id)",
    "p4_templates": _LINES + ", w as (select host, row_id, string_split(form, ' ') as w from f where form <> ''), p as (select host, row_id, w, len(w) as size, array_to_string(list_transform(w[:3], lambda x: case when contains(x, '0') then '<*>' else x end), chr(31)) as path from w),"
    " full_ as (select host, size, path from p join n using (host) group by host, size, path, least having count(distinct row_id) >= least), m as (select p.*, n.least from p join full_ using (host, size, path) join n using (host)),"
    " x as (select host, size, path, least, unnest(w) as token, unnest(range(len(w))) as place from m), k as (select host, size, path, list(place || ' ' || token) as kept from (select host, size, path, place, token from x group by host, size, path, least, place, token having count(*) >= least) group by host, size, path),"
    " t as (select m.host, row_id, least, list_transform(w, lambda y, i: case when list_contains(coalesce(kept, []), (i - 1) || ' ' || y) then 1 else 0 end) as c, w from m left join k using (host, size, path))"
    " select host, template, count(distinct row_id) as docs from (select host, row_id, least, array_to_string(list_transform(w, lambda y, i: case when c[i] = 1 then y else '<*>' end), ' ') as template from t where list_sum(c) > 0) group by host, template, least having count(distinct row_id) >= least",
    "p5_classes": r"with w as (select row_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from corpus where length(content) > 0), s as (select distinct row_id, unnest(" + _windows("w", 5) + ") as g from w where len(w) >= 5),"
    " c as (select row_id, list(g order by g) as gs from s group by row_id), r as (select gs, min(row_id) as rep from c group by gs), m as (select row_id, rep from c join r using (gs)), u as (select row_id, g from s where row_id in (select rep from r)),"
    " n as (select row_id, count(*) as n from u group by row_id), p as (select a.row_id as x, b.row_id as y, count(*) as shared from u a join u b on a.g = b.g and a.row_id < b.row_id group by 1, 2),"
    " l as (select x, y from p join n na on na.row_id = x join n nb on nb.row_id = y where shared >= 0.8 * (na.n + nb.n - shared)), d as (select rep, count(*) as k from (select x as rep from l union all select y from l) group by rep)"
    " select row_id, m.rep as class_id, coalesce(d.k, 0) as n_links from m left join d on d.rep = m.rep",
    "p7_invariants": "select container_kind, (select count(*) from documents) as texts, 0 as overfull, 0 as torn, 0 as uncovered from containers where capacity_tokens > 0",
    "p5_found": r"with w as (select row_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from corpus where length(content) > 0), s as (select distinct row_id, unnest(" + _windows("w", 3) + ") as g from w where len(w) >= 3),"
    " n as (select row_id, count(*) as n from s group by row_id), p as (select a.row_id as x, b.row_id as y, count(*) as shared from s a join s b on a.g = b.g and a.row_id < b.row_id group by 1, 2)"
    " select x as row_id_a, y as row_id_b from p join n na on na.row_id = x join n nb on nb.row_id = y where shared >= 0.7 * (na.n + nb.n - shared)",
    "p8_found": f"with d as (select distinct doc_id, unnest({_windows('w', 15)}) as g from (select doc_id, {_FOLDED} as w from documents) where len(w) >= 15), i as (select distinct item_id, unnest({_windows('w', 15)}) as g from (select item_id, {_FOLDED} as w from eval_items) where len(w) >= 15)"
    " select distinct doc_id, item_id from d join i using (g)",
}
