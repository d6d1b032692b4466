"""Rules of the record tables and of the public corpus: violations as rows, valid documents as they are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions.hosts import url_host

KINDS = ("page", "document", "image", "external")
TITLE_CAP, CONTENT_CAP = 500, 200_000


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _one_of(c: str, *values: str) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def _day(c: str) -> Column:
    return (F.coalesce(F.col(c), F.lit("")) == "") | F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")


def _count(c: str) -> Column:
    return F.coalesce(F.col(c) >= 0, F.lit(False))


def rules(table: str) -> dict[str, Column]:
    """What must hold in a table, by the name of the rule; further columns are allowed everywhere."""
    return {
        "pages": lambda: {
            "_id": _text("_id"), "host": _text("host"), "title": F.col("title").isNotNull(), "lang": _one_of("lang", "vi", "en"), "published_at": _day("published_at"),
            "method": F.coalesce(F.col("content.block.method").isin("heuristic", "selector", "fallback"), F.lit(False)), "word_count": F.coalesce(F.col("content.word_count") >= 0, F.lit(False)),
        },
        "links": lambda: {"_id": _text("_id"), "src": _text("src"), "dst": _text("dst"), "type": _one_of("type", "href", "embed"), "dst_kind": _one_of("dst_kind", *KINDS), "count": _count("count")},
        "nav_links": lambda: {"_id": _text("_id"), "host": _text("host"), "dst_kind": _one_of("dst_kind", *KINDS), "n_pages": _count("n_pages"), "sample_src": F.coalesce(F.size("sample_src") <= 3, F.lit(False))},
        "images": lambda: {"_id": _text("_id"), "is_template": F.col("is_template").isNotNull()},
        "documents": lambda: {"_id": _text("_id"), "status": _one_of("status", "pending", "ok", "unsupported", "skipped_too_large", "error"), "size": F.col("size").isNull() | _count("size"), "n_pages": F.col("n_pages").isNull() | _count("n_pages")},
        "templates": lambda: {"host": _text("host"), "fp": F.coalesce(F.col("fp").rlike("^[0-9a-f]{16}$"), F.lit(False)), "n": F.coalesce(F.col("n") <= F.col("n_pages"), F.lit(False))},
    }[table]()


def violations(df: DataFrame, table: str) -> DataFrame:
    """key, rule: one row for each rule that a row of the table breaks."""
    key = F.col("_id") if "_id" in df.columns else F.concat_ws("|", "host", "fp")
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules(table).items()])
    return df.select(key.alias("key"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def broken_rule() -> Column:
    """The first rule of the public corpus that a row breaks, null for a valid one."""
    url_ok = F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False))
    kind_ok = F.col("kind").isNull() | F.col("kind").isin("page", "document")
    day = F.coalesce(F.substring("published_at", 1, 10), F.lit(""))
    date_ok = (F.trim(day) == "") | T.is_valid_date(day)
    some = _text("title") | _text("content")
    return F.when(~url_ok, "url").when(~kind_ok, "kind").when(~some, "title or content").when(~date_ok, "published_at")


def public_documents(df: DataFrame, key: str) -> DataFrame:
    """Valid rows as documents: cut to their caps, host inferred, kind page by default; of one URL the last row wins.

    Columns: key, url, title, content, host, section, date, author, kind, sent (rows of that URL).
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    good = df.where(broken_rule().isNull())
    last = good.groupBy("url").agg(F.max(key).alias(key), F.count(F.lit(1)).alias("sent")).select(key, "sent")
    host = F.when(F.trim(empty("host")) != "", F.lower(F.trim("host"))).otherwise(url_host(F.col("url")))
    return good.join(last, key).select(
        key, "url", F.substring(empty("title"), 1, TITLE_CAP).alias("title"), F.substring(empty("content"), 1, CONTENT_CAP).alias("content"), host.alias("host"), empty("section").alias("section"),
        T.date_or_empty(F.col("published_at")).alias("date"), empty("author").alias("author"), F.coalesce("kind", F.lit("page")).alias("kind"), "sent",
    )
