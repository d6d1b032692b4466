"""Crawl frontier over recorded pages: rounds of a breadth-first walk, pagination, pacing, date-bounded listings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.plans.session import materialize

MAX_DEPTH, MAX_PAGES_OF_LISTING = 6, 400
#: Fixed values of the pacing: factor and cap after a 429, factor after a run of good answers.
SLOWER, CAP, FASTER, RUN = 1.5, 30.0, 0.9, 25
#: Fixed values of fetching: tries of a URL, how many 429 it may meet, and the seconds after one that names none.
RETRIES, THROTTLES, PAUSE = 3, 8, 30.0


def push(found: DataFrame, queued: DataFrame, home: str, langs: tuple[str, ...] = (), rules: str = "", only_listing: bool = False) -> DataFrame:
    """url, key, depth, via, front of the links of a round that join the queue.

    found: url, depth, via, ord. Links out of scope or already queued are left out; of links to one article the first in order is
    taken; articles go to the front of the queue unless only listings are wanted.
    """
    rows = found.withColumn("url", U.normalized(F.col("url"))).where(F.col("url").isNotNull() & U.in_scope(F.col("url"), home, suffix=True))
    if langs:
        rows = rows.where(U.lang_of(F.col("url")).isin(*langs))
    if rules:
        rows = rows.where(U.can_fetch(F.lit(rules), F.lit("webloom"), F.col("url")))
    if only_listing:
        rows = rows.where(U.kind_of(F.col("url")) != "article")
    rows = rows.withColumn("key", F.coalesce(U.dedup_key(F.col("url")), F.col("url")))
    first = rows.groupBy("key").agg(F.min(F.struct("depth", "ord", "url", "via")).alias("m")).select("key", "m.url", "m.depth", "m.via")
    fresh = first.join(queued.select("key").distinct(), "key", "left_anti")
    return fresh.withColumn("front", U.kind_of(F.col("url")) == "article")


def walk(links: DataFrame, seeds: DataFrame, home: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, key, depth, via of everything a breadth-first walk over recorded links reaches within max_depth rounds.

    links: src, dst. Each round is one anti-join against what is queued; every round is written to the shared folder, so the plan
    doesn't grow.
    """
    key = F.coalesce(U.dedup_key(F.col("url")), F.col("url"))
    queued = materialize(seeds.select(U.normalized(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct().select("url", key.alias("key"), F.lit(0).alias("depth"), F.lit("seed").alias("via")))
    level, reached = queued, [queued]
    edges = links.select(U.normalized(F.col("src")).alias("url"), "dst").where(F.col("url").isNotNull())
    for depth in range(1, max_depth + 1):
        found = level.select("url").join(edges, "url").select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), F.col("url").alias("via"), F.col("dst").alias("ord"))
        level = materialize(push(found, queued, home).select("url", "key", "depth", "via"))
        if level.isEmpty():
            break
        reached.append(level)
        queued = queued.unionByName(level)
    return queued


def split_visited(links: DataFrame, home: str) -> DataFrame:
    """url, what of the targets of visited pages: an asset or a page to enqueue."""
    u = U.normalized(F.col("dst"))
    rows = links.select(u.alias("url")).where(F.col("url").isNotNull() & U.in_family(U.hostname(F.col("url")), home)).distinct()
    return rows.select("url", F.when(U.path_of(F.col("url")).rlike(U.ASSET), "asset").otherwise("page").alias("what"))


def expand_pagination(found: DataFrame) -> DataFrame:
    """template, stem, n, url: all numbered pages up to the greatest number seen of each listing, from the second on."""
    p = U.page_of(F.col("url"))
    top = found.select(p["template"].alias("template"), p["stem"].alias("stem"), p["n"].alias("n")).where("template is not null").groupBy("template", "stem").agg(F.max("n").alias("top"))
    rows = top.where("top >= 2").select("template", "stem", F.explode(F.sequence(F.lit(2).cast("bigint"), F.least("top", F.lit(MAX_PAGES_OF_LISTING)))).alias("n"))
    return rows.withColumn("url", F.replace(F.col("template"), F.lit("{n}"), F.col("n").cast("string")))


def pacing(responses: DataFrame, base: float = 2.5) -> DataFrame:
    """host, ord, delay: the delay after each recorded answer of a host, in order.

    A 429 slows down (up to a cap), a run of good answers speeds up again (down to the base). The fold is sequential by nature: it
    runs host by host, over narrow rows; hosts' answers come in at the polite pace this very fold keeps.
    """
    shape = "host string, ord bigint, delay double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        delay, good, out = base, 0, []
        for status in pdf["status"]:
            if status == 429:
                delay, good = min(delay * SLOWER, CAP), 0
            elif status is not None and status < 400:
                good += 1
                if good >= RUN:
                    delay, good = max(delay * FASTER, base), 0
            out.append(delay)
        return pd.DataFrame({"host": pdf["host"], "ord": pdf["ord"], "delay": out})

    return responses.select("host", "ord", "status").groupBy("host").applyInPandas(lambda pdf: fold(pdf), shape)


def fetch_outcomes(attempts: DataFrame, retries: int = RETRIES, throttles: int = THROTTLES) -> DataFrame:
    """url, attempts, waited, outcome of every URL by its recorded answers (url, ord, status; no status is no answer).

    A good answer ends it (done), and so does one that says there is nothing to have (403, 404, 410); other errors are tried again
    after 2, 4, ... seconds until there are as many as retries; a 429 waits longer and has a count of its own. A URL whose answers
    end before either is open.
    """
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = F.coalesce("status", F.lit(0))
    ok = ((status > 0) & (status < 400)) | status.isin(403, 404, 410)
    slow = status == 429
    rows = attempts.select("url", "ord", ok.alias("ok"), slow.alias("slow"), (~ok & ~slow).alias("bad"))
    rows = rows.withColumns({"tries": F.sum(F.col("bad").cast("int")).over(w), "waits": F.sum(F.col("slow").cast("int")).over(w)})
    over = F.col("ok") | (F.col("tries") >= retries) | (F.col("waits") >= throttles)
    rows = rows.withColumn("over", F.sum(over.cast("int")).over(w) - over.cast("int")).where("over = 0")  # up to the answer that ends it
    pause = F.when(F.col("bad"), F.pow(F.lit(2.0), F.col("tries"))).when(F.col("slow"), F.lit(PAUSE)).otherwise(0.0)
    outcome = F.when(F.max("ok"), "done").when((F.max("tries") >= retries) | (F.max("waits") >= throttles), "given up").otherwise("open")
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.sum(pause).alias("waited"), outcome.alias("outcome"))


def recent_listing(cards: DataFrame, since: str, until: str) -> DataFrame:
    """page_url, matched, future, monotonic, stop: per listing page, the dated links between two days (YYYY-MM-DD).

    A page whose dates never rise may stop the walk at its first card older than since; one that isn't monotonic is read to its end.
    """
    w = Window.partitionBy("page_url").orderBy("pos")
    rows = cards.where(F.coalesce("date", F.lit("")) != "").withColumn("before", F.lag("date").over(w))
    return rows.groupBy("page_url").agg(
        F.count_if(F.col("date").between(since, until)).alias("matched"), F.count_if(F.col("date") > until).alias("future"),
        F.coalesce(F.min(F.col("before").isNull() | (F.col("date") <= F.col("before"))), F.lit(True)).alias("monotonic"), F.min(F.when(F.col("date") < since, F.col("pos"))).alias("first_old"),
    ).withColumn("stop", F.col("monotonic") & F.col("first_old").isNotNull())


def recent_links(cards: DataFrame, since: str, until: str) -> DataFrame:
    """listing, page_no, pos, url, date of the dated links between two days, of the pages that a walk of each listing reads.

    cards: listing, page_no, pos, url, date (YYYY-MM-DD or ''). On a page whose dates never rise the walk ends at the first card older
    than since, and with it the listing's; other pages are read to their end.
    """
    pages = recent_listing(cards.withColumn("page_url", F.struct("listing", "page_no")), since, until).select("page_url.*", "stop", "first_old")
    ends = pages.where("stop").groupBy("listing").agg(F.min("page_no").alias("end"))
    rows = cards.join(pages, ["listing", "page_no"]).join(ends, "listing", "left").where(F.col("end").isNull() | (F.col("page_no") <= F.col("end")))
    read = ~F.col("stop") | (F.col("pos") < F.col("first_old"))
    return rows.where(F.col("date").between(since, until) & read).select("listing", "page_no", "pos", "url", "date")


def queue_recent(matched: DataFrame, queued: DataFrame, home: str, max_pages: int | None = None) -> DataFrame:
    """url, key, depth, via, front of the matched links that join the queue before everything else: the newest first, at most max_pages
    of them; links already queued, aliases of queued articles and links out of scope are left out."""
    newest = matched.groupBy("url").agg(F.max("date").alias("date"))
    if max_pages is not None:
        newest = newest.orderBy(F.col("date").desc(), "url").limit(max_pages)
    found = newest.select("url", F.lit(1).alias("depth"), F.lit("recent").alias("via"), F.struct(F.datediff(F.lit("9999-12-31"), F.col("date").cast("date")), "url").alias("ord"))
    return push(found, queued, home).withColumn("front", F.lit(True))


def within_budget(queued: DataFrame, max_pages: int) -> DataFrame:
    """queued with state: the first max_pages URLs by depth, articles first, then URL, are done, the others parked for a later run."""
    order = ["depth", F.when(U.kind_of(F.col("url")) == "article", 0).otherwise(1), "url"]
    done = queued.orderBy(*order).limit(max_pages).select("key", F.lit("done").alias("state"))
    return queued.join(done, "key", "left").withColumn("state", F.coalesce("state", F.lit("parked")))


def save_state(state: DataFrame, path: str) -> None:
    """Writes a crawl's state (url, key, depth, via, state) for a later run."""
    state.select("url", "key", "depth", "via", "state").write.mode("overwrite").parquet(path)


def resume(spark: SparkSession, path: str, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(done, frontier) of a saved state; extra (url), as read from a file of URLs, joins the frontier unless it is known."""
    state = spark.read.schema("url string, key string, depth int, via string, state string").parquet(path)
    done, parked = state.where("state = 'done'").drop("state"), state.where("state <> 'done'").drop("state")
    if extra is not None:
        u = U.normalized(F.col("url"))
        more = extra.select(u.alias("url"), F.coalesce(U.dedup_key(u), u).alias("key"), F.lit(0).alias("depth"), F.lit("file").alias("via")).where("url is not null").dropDuplicates(["key"])
        parked = parked.unionByName(more.join(state.select("key"), "key", "left_anti").select("url", "key", "depth", "via"))
    return done, parked


def manifest(records: DataFrame, states: DataFrame) -> DataFrame:
    """what, n: counters of a crawl: records by kind, URLs by state."""
    a = records.groupBy(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit(""))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(states.groupBy(F.concat(F.lit("state:"), F.col("state")).alias("what")).agg(F.count(F.lit(1)).alias("n")))


def check_crawl_request(mode: str, since: str | None = None, until: str | None = None) -> None:
    """Raises ValueError for an unknown mode or dates that aren't real days in order."""
    from datetime import date

    if mode not in ("full", "listing", "articles", "recent", "from-file"):
        raise ValueError(f"unknown mode {mode}")
    days = [date.fromisoformat(x) for x in (since, until) if x]
    if mode == "recent" and not since:
        raise ValueError("recent needs since")
    if len(days) == 2 and days[0] > days[1]:
        raise ValueError("since is after until")
