"""Templates, entity resolution, aggregates, upserts, frontier, audits."""

import base64
from datetime import date

import pytest
from pyspark.sql import functions as F

from webloom.operators import audit as A
from webloom.operators import extraction as X
from webloom.operators import frontier as L
from webloom.operators import graph as G
from webloom.operators import pipeline as P

RAW = "rec_id bigint, store string, shard string, line_no int, url string, status int, encoding string, html_b64 string, kind string, fetched_at string, sha1 string, size bigint, content_type string"


def record(i, url, html=None, status=200, encoding="utf-8"):
    return (i, "raw", "pages-0000.jsonl", i, url, status, encoding, None if html is None else base64.b64encode(html.encode()).decode(), "article", "2026-01-01T00:00:00", "s", 1, "text/html")


def test_templates_need_enough_pages(spark):
    html = "<ul><li>Menu chung</li></ul><p>Nội dung riêng số {0} của trang {1}</p>"
    for n, active in ((25, 1), (10, 0)):
        raw = spark.createDataFrame([record(i, f"https://h.vn/{i}", html.format(i, chr(97 + i))) for i in range(n)], RAW)
        table = X.template_table(X.page_fingerprints(X.decoded(raw)))
        menu = table.orderBy(F.col("n").desc()).first()
        assert (menu["n_pages"], menu["n"]) == (n, n) and X.active_templates(table).where(F.col("fp") == menu["fp"]).count() == active


def test_decoding():
    b = base64.b64encode("é".encode("cp1252")).decode()
    assert X.decode_html(b, "windows-1252", 200) == "é" and X.decode_html(b, "no-such", 200) == "�" and X.decode_html(b, "utf-8", 404) is None and X.decode_html(None, None, 200) is None and X.decode_html("a", None, 200) is None


def test_entities_and_aliases(spark):
    rows = [
        (1, "https://h.vn/a/x-1.html", 1, False), (2, "https://h.vn/b/x-1.html", 2, True), (3, "https://h.vn/a/x-1.html", 3, True), (4, "https://h.vn/c/x-1.html", 4, False), (5, "https://h.vn/c/x-1.html", 5, True),
        (6, "https://h.vn/b/y-1.html", 6, True), (7, None, 7, True), (8, "https://h.vn/z", 8, False),
    ]
    df = spark.createDataFrame(rows, "rec_id bigint, norm string, o int, ok boolean")
    got = {r["key"]: (r["primary_id"], r["primary_url"], r["aliases"]) for r in P.resolve_entities(df, ["o"], "ok").collect()}
    assert got == {"x-1.html": (2, "https://h.vn/b/x-1.html", ["https://h.vn/a/x-1.html", "https://h.vn/c/x-1.html"]), "y-1.html": (6, "https://h.vn/b/y-1.html", [])}
    assert P.resolve_entities(df.limit(0), ["o"], "ok").count() == 0


def test_extraction_is_idempotent_and_counts_once(spark):
    page = "<nav><a href=/vi/>Tuyển sinh</a></nav><h1>Tin {0}</h1><div class=content><p>Đoạn văn {0} đủ dài, có dấu câu.</p><a href=/t.pdf>Tệp</a><img src=/i.jpg alt=Ảnh></div>"
    raw = spark.createDataFrame([record(1, "http://www.h.vn/a-1.html", page.format(1)), record(2, "https://h.vn/x/a-1.html", page.format(1)), record(3, "https://h.vn/b-1.html", page.format(2)), record(4, "https://h.vn/e", None)], RAW)
    a, b = (sorted(map(str, X.extract_pages(X.decoded(X.first_per_url(raw)), "h.vn").collect())) for _ in range(2))
    assert a == b and len(a) == 3
    got = X.extract_pages(X.decoded(raw), "h.vn")
    nav = P.nav_links(P.exploded_edges(got, "nav_edges")).collect()
    assert [(r["text"], r["n_pages"], len(r["sample_src"])) for r in nav] == [("Tuyển sinh", 3, 3)]
    images = P.images(P.exploded_edges(got, "content_edges"), P.exploded_edges(got, "nav_edges")).collect()
    assert [(r["_id"], r["alts"], r["is_template"]) for r in images] == [("https://h.vn/i.jpg", ["Ảnh"], False)]


def test_explained_blocks_are_those_of_the_extraction(spark, tmp_path):
    from webloom.plans import record_queries as R

    html = "<title>Tin {0}</title><body><div><ul><li>Menu chung của trang <a href=/m>một</a></li></ul><p>Nội dung riêng số {0} của trang {1}, đủ dài. <a href=/t{0}.pdf>Tệp</a></p></div></body>"
    spark.createDataFrame([record(i, f"https://h.vn/{i}", html.format(i, chr(97 + i))) for i in range(25)], RAW).write.parquet(f"{tmp_path}/raw_pages.parquet")
    told = {r["rec_id"]: r for r in R.explain_blocks(spark, str(tmp_path)).collect()}
    made = {r["rec_id"]: r for r in R._extracted(spark, str(tmp_path)).collect()}
    assert len(told) == 25 and all(0 < r["after_template"] < r["after_clean"] for r in told.values())
    assert all((told[i]["content_edges"], told[i]["nav_edges"]) == (len(r["content_edges"]), len(r["nav_edges"])) for i, r in made.items())


def test_index_records_hold_pages_and_files(spark, tmp_path):
    from webloom.plans import record_queries as R

    page = "<title>Tin {0}</title><h1>Tin {0}</h1><div class=content><p>Đoạn văn {0} đủ dài, có dấu câu.</p></div>"
    stored = [record(1, "http://www.h.vn/a-1.html", page.format(1)), record(2, "https://h.vn/x/a-1.html", page.format(1)), record(3, "https://h.vn/b-1.html", page.format(2)), record(4, "https://h.vn/e", None), record(5, "https://h.vn/c-1.html", page.format(3), 404)]
    spark.createDataFrame(stored, RAW).write.parquet(f"{tmp_path}/raw_pages.parquet")
    files = [("https://h.vn/t%20t.pdf", "ok", "chữ"), ("https://h.vn/u.pdf", "ok", ""), ("https://h.vn/v.pdf", "error", "chữ"), ("https://h.vn/w.pdf", "ok", None)]
    spark.createDataFrame([(u, s, t, "h.vn", "pdf") for u, s, t in files], "url string, status string, text string, host string, ext string").write.parquet(f"{tmp_path}/files_ok.parquet")
    made = {}
    for i, url, html, status in [(r[0], r[4], r[7], r[5]) for r in stored]:  # one page at a time, the first of each last segment
        body = X.decode_html(html, "utf-8", status)
        norm = url.replace("http://www.", "https://")
        found = X.dom.extract(body, norm, frozenset(), R.HOME) if body else None
        if found:
            made.setdefault(norm.rsplit("/", 1)[-1], (norm, found["title"], "page", "html", len(found["text"])))
    got = {(r["url"], r["title"], r["kind"], r["ftype"], r["chars"]) for r in R.index_records(spark, str(tmp_path)).collect()}
    assert len(made) == 2 and got == set(made.values()) | {("https://h.vn/t%20t.pdf", "t t.pdf", "document", "pdf", 3)}


def test_upsert_and_last_per_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in P.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    df = spark.createDataFrame([(1, "u", "x"), (3, "u", "z"), (2, "u", "y"), (1, None, "n")], "s int, url string, v string")
    assert {(r["url"], r["v"]) for r in P.last_per_key(df, "url", ["s"]).collect()} == {("u", "z"), (None, "n")}


def test_download_states(spark):
    rows = [("a", 200, 10, "pdf", True), ("b", 429, 0, "pdf", True), ("c", 404, 0, "pdf", True), ("d", 200, 60 << 20, "pdf", True), ("e", 200, 1, "zip", True), ("f", 200, 1, "pdf", False), ("g", None, None, "pdf", None)]
    out = {r["url"]: r["next_status"] for r in G.download_transition(spark.createDataFrame(rows, "url string, status int, size bigint, ext string, allowed boolean")).collect()}
    assert out == {"a": "downloaded", "b": "pending", "c": "error", "d": "skipped_too_large", "e": "unsupported", "f": "error", "g": "error"}


def test_pacing(spark):
    statuses = [429, 429, *[200] * 60, 500, None, *[429] * 12]
    df = spark.createDataFrame([("h", i, s) for i, s in enumerate(statuses)], "host string, ord bigint, status int")
    delays = [r["delay"] for r in L.pacing(df).orderBy("ord").collect()]
    assert delays[1] == pytest.approx(5.625) and delays[26] == pytest.approx(5.625 * 0.9) and delays[-1] == 30.0 and min(delays) >= 2.5


@pytest.mark.parametrize(
    "dates,since,matched,stop", [(["2026-10-10", "2026-10-05", "2026-10-01"], "2026-10-08", 1, True), (["2026-09-01", "2026-10-10", "2026-10-09"], "2026-10-08", 2, False), (["2099-01-01", "2026-10-10"], "2026-10-08", 1, False)]
)
def test_recent_listing(spark, dates, since, matched, stop):
    df = spark.createDataFrame([("p", i, d) for i, d in enumerate(dates)], "page_url string, pos int, date string")
    r = L.recent_listing(df, since, "2026-12-31").first()
    assert (r["matched"], r["stop"]) == (matched, stop) and r["future"] == sum(d > "2026-12-31" for d in dates)


def test_walk_and_pagination(spark):
    links = spark.createDataFrame([("https://h.vn/", "https://h.vn/a"), ("https://h.vn/a", "https://h.vn/b"), ("https://h.vn/b", "https://h.vn/c"), ("https://h.vn/a", "https://x.vn/"), ("https://h.vn/b", "https://h.vn/a")], "src string, dst string")
    out = {r["url"]: r["depth"] for r in L.walk(links, spark.createDataFrame([("https://h.vn/",)], "url string"), "h.vn", 2).collect()}
    assert out == {"https://h.vn/": 0, "https://h.vn/a": 1, "https://h.vn/b": 2}
    pages = L.expand_pagination(spark.createDataFrame([("https://h.vn/c/page-3/",), ("https://h.vn/c/page-2/",), ("https://h.vn/d",), (None,)], "url string"))
    assert sorted(r["url"] for r in pages.collect()) == ["https://h.vn/c/page-2/", "https://h.vn/c/page-3/"]


def test_walk_query_goes_as_deep_as_the_operator(spark, tmp_path):
    from webloom.plans import audit_queries as Q

    step = lambda i: f"https://tin.bachlam.example/s{i}/"
    spark.createDataFrame([(step(i), step(i + 1)) for i in range(9)], "src string, dst string").write.parquet(f"{tmp_path}/links.parquet")
    spark.createDataFrame([(step(0), "listing")], "url string, kind string").write.parquet(f"{tmp_path}/raw_pages.parquet")
    assert {r["url"]: r["depth"] for r in Q.frontier_walk(spark, str(tmp_path)).collect()} == {step(i): i for i in range(L.MAX_DEPTH + 1)}


def test_crawl_requests():
    L.check_crawl_request("recent", "2026-01-01", str(date(2026, 2, 1)))
    for bad in (("fast",), ("recent",), ("recent", "2026-02-30"), ("recent", "2026-02-02", "2026-01-01")):
        with pytest.raises(ValueError):
            L.check_crawl_request(*bad)


def test_hrefs(spark):
    html = """<a class=x href="/a">1</a><A HREF='b'>2</A><a href=c>3</a><a name=q>4</a><img src="i.png">"""
    row = spark.createDataFrame([(html,)], "h string").select(A.hrefs(F.col("h")).alias("a"), A.hrefs(F.col("h"), True).alias("b")).first()
    assert row["a"] == ["/a", "b", "c"] and row["b"] == ["/a", "b", "c", "i.png"]
