"""Golden values of URL, text, date and hash functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.simhash import fnv1a, shingles, simhash


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


NORM = [
    ("https://uni.example/a.html?fbclid=xyz&utm_source=fb#doan-2", "https://uni.example/a.html"), ("http://www.uni.example/x.pdf", "https://uni.example/x.pdf"),
    ("https://uni.example/vi/index?page=5", "https://uni.example/vi/index?page=5"), ("javascript:void(0)", None), ("mailto:a@b.c", None), (None, None), ("", None), ("#x", None),
    ("https://xwww.y/a//b;p=1?&a=1&&", "https://xy/a/b?a=1"), ("  https://A.B/C \n", "https://a.b/C"),
]


@pytest.mark.parametrize("url,expected", NORM)
def test_norm(spark, url, expected):
    assert one(spark, U.normalized(F.col("u").cast("string")), u=url) == expected
    assert U.python_norm(url, "https://uni.example/") == expected or (url == "#x" and expected is None)


def test_relative_links_follow_their_page():
    assert U.python_norm("../x.html?gidzl=1", "https://www.a.b/c/d/e.html") == "https://a.b/c/x.html"
    assert U.python_norm("//c.d/e", "https://a.b/") == "https://c.d/e"


def test_dedup_key_is_the_last_segment(spark):
    key = lambda u: one(spark, U.dedup_key(F.col("u")), u=u)
    assert key("https://a.vn/x/slug-12.html") == key("https://b.vn/y/z/slug-12.html") == "slug-12.html"
    assert key("https://a.vn/x/other-12.html") != key("https://a.vn/x/slug-12.html")
    assert key("https://a.vn/vi/news/") is None


def test_page_of_and_kind(spark):
    p = one(spark, U.page_of(F.col("u")), u="https://a.vn/news/cat/page-90/")
    assert (p["template"], p["n"], p["stem"]) == ("https://a.vn/news/cat/page-{n}/", 90, "https://a.vn/news/cat/")
    kinds = {"https://a.vn/x-1.html": "article", "https://a.vn/c/page-2/": "listing-page", "https://a.vn/c/": "listing", "https://a.vn/c": "other", "https://a.vn/c?page=2": "listing-page"}
    for u, k in kinds.items():
        assert one(spark, U.kind_of(F.col("u")), u=u) == k


def test_scope(spark):
    scope = lambda u, suffix=False: one(spark, U.in_scope(F.col("u"), "a.vn", suffix), u=u)
    assert scope("https://a.vn/x") and not scope("https://lib.a.vn/x") and scope("https://lib.a.vn/x", True)
    assert not scope("https://a.vn/x.pdf") and not scope("https://a.vn/x?submit=1") and not scope("https://a.vn/vi/rss/")


def test_dest_kind(spark):
    kind = lambda u: one(spark, U.dest_kind(F.col("u"), "uni.example"), u=u)
    assert kind("https://drive.google.com/x") == "external" and kind("https://uni.example/a.jpg") == "image" and kind("https://uni.example/f?download=1") == "document"
    assert kind("https://uni.example/vi/") == "page" and kind("https://notuni.example/a.pdf") == "external"


def test_blocked(spark):
    blocked = lambda s, h: one(spark, U.looks_blocked(F.col("s"), F.col("h")), s=s, h=h)
    assert blocked(403, "x") and blocked(200, "<title>Just a moment</title>") and blocked(200, "<div id=app></div>")
    assert not blocked(200, "<a href=x>" * 30 + "word " * 300)


def test_robots_first_match_wins():
    rules = U.Rules("User-agent: *\nAllow: /a/b\nDisallow: /a\n\nUser-agent: me\nDisallow: /x\nAllow: /x/y\n")
    assert rules.allows("you", "https://h/a/b/c") and not rules.allows("you", "https://h/a/c") and rules.allows("you", "https://h/")
    assert not rules.allows("me/2.0", "https://h/x/y") and rules.allows("me", "https://h/a/c")
    assert U.Rules("").allows("you", "https://h/a") and U.Rules("User-agent: *\nDisallow:").allows("you", "https://h/a")


@pytest.mark.parametrize("text,expected", [("… 30/09/2026", "2026-09-30"), ("2/3/2026", "2026-03-02"), ("31/02/2026", ""), ("123/04/2026999", ""), (None, ""), ("", "")])
def test_parse_date_vn(spark, text, expected):
    assert one(spark, T.parse_date_vn(F.col("t").cast("string")), t=text) == expected


def test_dates(spark):
    norm = lambda t: one(spark, T.normalize_date(F.col("t")), t=t)
    assert norm("Đăng ngày 05/09/2026 10:30") == "2026-09-05" and norm("2026-08-22T10:00:00+07:00") == "2026-08-22" and norm("2026-13-40") == ""
    num = lambda t: one(spark, T.date_num(F.col("t").cast("string")), t=t)
    assert [num(x) for x in ("2026-08-09", "", "2026-13-40", "hôm qua", "2026-02-31", None)] == [20260809, 0, 0, 0, 20260231, 0]


def test_suspect_encoding(spark):
    suspect = lambda t: one(spark, T.suspect_encoding(F.col("t")), t=t)
    assert suspect("Tr­êng §¹i häc khoa häc " * 12) and not suspect("Trường Đại học Bạch Lâm " * 8) and not suspect("é" * 50)


def test_link_key(spark):
    key = one(spark, T.sha1_key(*[F.lit(x) for x in ("https://uni.example/a-1.html", "https://uni.example/tệp.pdf", "href", "Xem chi tiết")]))
    assert key == hashlib.sha1("https://uni.example/a-1.html|https://uni.example/tệp.pdf|href|Xem chi tiết".encode()).hexdigest()


def test_factors(spark):
    assert one(spark, T.recency_factor(F.lit(""), 2026)) == 1.0 and one(spark, T.recency_factor(F.lit("2026-01-01"), 2026)) == pytest.approx(1.08)
    assert one(spark, T.page_type(F.lit("https://a/page-2/x.html"))) == 0.5 and one(spark, T.length_factor(F.lit(600))) == pytest.approx(0.875)


def test_fnv_equals_the_plain_loop():
    def plain(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = ((h ^ x) * 0x100000001B3) % (1 << 64)
        return h

    texts = [b"", b"a", b"foobar", "đại học".encode(), b"x" * 300]
    assert [int(h) for h in fnv1a(texts)] == [plain(t) for t in texts]


def test_simhash(spark):
    base = " ".join(f"từ{i} khác{i % 7}" for i in range(160))
    rows = [(1, base), (2, base.replace("từ5 ", "từ5 thêm ")), (3, "ngắn"), (4, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", simhash(F.lit(""), F.col("t")).alias("s"))
    sig = {r["i"]: r["s"] for r in df.collect()}
    assert sig[3] == sig[4] == 0 and sig[1] != 0
    assert bin((sig[1] ^ sig[2]) & (2**64 - 1)).count("1") <= 12
    assert shingles(" .a b c") == [b"a b c"]


def test_fingerprints_are_of_whole_texts(spark, tmp_path):
    from webloom.plans import url_queries as Q

    spark.createDataFrame([(1, "a b " * 100 + "end"), (2, "a b " * 100 + "other"), (3, "A  b " * 100 + "END")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in Q.text_fingerprints(spark, str(tmp_path)).collect()}
    assert got[1] == got[3] != got[2]
