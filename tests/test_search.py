"""The search contract: what is found, in which order, and what never changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.functions.simhash import simhash
from webloom.operators import index as I
from webloom.operators import search as S

SCHEMA = "id bigint, url string, title string, text string, host string, section string, author string, kind string, ftype string, date string"
LONG = " ".join(f"nội dung câu số {i} nói về đề tài {i % 13} của trường" for i in range(60))


def doc(i, title="", text="", **kw):
    return (i, kw.get("url", f"https://h.vn/bai-{i}.html"), title, text, kw.get("host", "h.vn"), kw.get("section", ""), "", kw.get("kind", "page"), kw.get("ftype", "html"), kw.get("date", ""))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        doc(1, "Học bổng khuyến khích", "Danh sách sinh viên nhận học bổng kỳ này", date="2024-05-01"), doc(2, "Lịch thi", "Có nhắc tới học bổng một lần trong bài", date="2020-01-01"), doc(3, "Hoc bong tu do", "khong dau"),
        doc(4, "Tuyển sinh", "bổng lộc và học hành", host="b.vn"), doc(5, "Điểm chuẩn", "điểm chuẩn năm nay của trường", kind="document", ftype="pdf", date="2023-03-03"), doc(6, None, None), doc(7, "Trang 2", "học bổng " * 3, url="https://h.vn/tin/page-2/"),
    ]
    return I.build(I.documents(spark.createDataFrame(rows, SCHEMA)))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_title_counts_more_and_accents_fold(docs):
    assert ids(S.ranked(docs, S.SearchParams("học bổng")))[0] == 1
    assert set(ids(S.ranked(docs, S.SearchParams("hoc bong", "tfidf")))) == {1, 2, 3, 4, 7}
    assert ids(S.ranked(docs, S.SearchParams("diem chuan", "tfidf"))) == [5]


def test_listings_sink(docs):
    found = ids(S.ranked(docs, S.SearchParams("học bổng")))
    assert found.index(7) > found.index(1)


def test_phrases_reorder_but_never_widen(docs):
    enhanced, plain = set(ids(S.ranked(docs, S.SearchParams("học bổng")))), set(ids(S.ranked(docs, S.SearchParams("học bổng", "tfidf"))))
    assert enhanced == plain
    order = ids(S.ranked(docs, S.SearchParams("học bổng")))
    assert order.index(2) < order.index(4)


def test_filters_never_score(docs):
    free = {r["id"]: r["score"] for r in S.ranked(docs, S.SearchParams("học bổng", "tfidf")).collect()}
    one = S.ranked(docs, S.SearchParams("học bổng", "tfidf", host="b.vn")).collect()
    assert [r["id"] for r in one] == [4] and one[0]["score"] == pytest.approx(free[4])
    assert ids(S.ranked(docs, S.SearchParams("học bổng", "tfidf", date_from="2021-01-01"))) == [1]
    assert ids(S.ranked(docs, S.SearchParams("điểm chuẩn", "tfidf", ftype="PDF, doc"))) == [5]
    assert ids(S.ranked(docs, S.SearchParams("học bổng", "tfidf", sort="date")))[:2] == [1, 2]


def test_relaxed_only_when_nothing_matches(docs):
    assert set(ids(S.ranked(docs, S.SearchParams("học zzz", "tfidf")))) == {1, 2, 3, 4, 7}
    assert ids(S.ranked(docs, S.SearchParams("học zzz yyy xxx www", "tfidf"))) == []


@pytest.mark.parametrize(
    "q,expected",
    [('"học bổng"', {1, 2, 7}), ("học -bổng", set()), ("học NOT nhắc", {1, 4, 7}), ("title:học", {1}), ("(lịch OR tuyển)", {2, 4}), ("+học +lộc", {4}), ("khuy*", {1}), ('"bổng học"~1', {7}), ('"bổng học"~2', {1, 2, 4, 7}), ("học bổng^3", {1, 2, 4, 7}),
     ("khuyên~1", {1}), ("khuyx~1", set()), ("khuyến~", {1}), ("bỗng~1", {1, 2, 3, 4, 7}), ("b?ng", {1, 2, 3, 4, 7}), ("tr*n*g", {2, 5, 7}), ("[điểm TO được]", {5}), ("{điểm TO điểm}", set()), ("text:[* TO bài}", set())],
)
def test_grammar(docs, q, expected):
    assert set(ids(S.matching(docs, S.parse_query(q), {"title": 1.0, "text": 1.0}))) == expected


def brute(q, rows):
    """Ids whose folded title or text holds every word, read directly."""
    words = [S.fold_python(w.lower()) for w in q.split()]
    tokens = {r[0]: set(re.findall(r"\w+", S.fold_python(f"{r[2] or ''} {r[3] or ''}".lower()))) for r in rows}
    return {i for i, t in tokens.items() if all(w in t for w in words)}


def test_hits_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "học bổng trường sinh viên đào tạo kỳ thi điểm chuẩn hoc bong đ Đ é ﬁ ́ x́".split()
    rows = [doc(i, " ".join(rng.choices(vocabulary, k=rng.randrange(4))), " ".join(rng.choices(vocabulary, k=rng.randrange(9)))) for i in range(200)]
    index = I.build(I.documents(spark.createDataFrame(rows, SCHEMA)), per_bucket=20)
    assert index.buckets == 10
    for q in ("học bổng", "dao tao", "thi", "điểm kỳ"):
        if brute(q, rows):
            assert set(ids(S.hits(index, S.SearchParams(q, "tfidf")))) == brute(q, rows)


def test_a_term_is_read_from_its_bucket_alone(spark):
    rows = [doc(i, "", f"chung tu{i}") for i in range(400)]
    index = I.build(I.documents(spark.createDataFrame(rows, SCHEMA)), per_bucket=40)

    def files(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = df._jdf.queryExecution().executedPlan()
            plan.executeCollect()
            scan = plan.collectLeaves().apply(0)
            return scan.metrics().apply("numFiles").value(), scan.metrics().apply("filesSize").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    every, one = files(index.postings), files(index.of("text", "tu7"))
    assert index.buckets == 10 and one[0] <= I.PARTS and 4 * one[1] < every[1] and [r["id"] for r in index.of("text", "tu7").collect()] == [7]
    plan = S.Plan([("text", S.Term(("tu7",))), ("text", S.Term(("chung",)))])
    read = files(S.gather(index, plan))
    assert read[0] <= 2 * I.PARTS and 2 * read[1] < every[1]


def test_totals_and_lists(docs):
    found = S.search(docs, S.SearchParams("học bổng", "tfidf", size=2))
    assert found.total == 5 and found.page.count() == 2
    page = S.list_page(docs, kind="page", size=3)
    assert page.total == 6 and [r["id"] for r in page.page.orderBy("rank").collect()] == [1, 2, 3]
    assert S.list_page(docs, host="none.vn").total == 0 and S.list_page(docs, host="none.vn").page.count() == 0
    assert [r["id"] for r in I.get_document(docs, "https://h.vn/bai-4.html").collect()] == [4] and I.get_document(docs, "x").count() == 0


@pytest.mark.parametrize("q", ["(a", "a)", "AND a", "a OR", "a^x", "((a) b", '"a', "*a", "?a"])
def test_bad_syntax(q):
    with pytest.raises(S.QuerySyntaxError):
        S.parse_query(q)


def test_bad_requests(docs):
    for p in (S.SearchParams(" "), S.SearchParams("a", "best"), S.SearchParams("a", size=0), S.SearchParams("a", from_=-1), S.SearchParams("a", sort="up")):
        with pytest.raises(ValueError):
            S.ranked(docs, p)


def test_near_duplicates_merge_before_paging(spark):
    copy = LONG.replace("câu số 7 ", "câu số bảy ")
    rows = [doc(1, "Học bổng A", LONG, url="https://h.vn/x/y/a-1.html"), doc(2, "Học bổng A", copy, url="https://h.vn/a-1.html"), *[doc(i, f"Học bổng {i}", f"khác hẳn {i} " * 9) for i in range(3, 9)]]
    docs = I.build(I.documents(spark.createDataFrame(rows, SCHEMA)))
    sig = {r["id"]: r["sig"] for r in docs.docs.select("id", simhash(F.col("title"), F.col("text")).alias("sig")).collect()}
    assert bin((sig[1] ^ sig[2]) & (2**64 - 1)).count("1") <= 3
    results = [S.search(docs, S.SearchParams("học bổng", from_=k, size=4)) for k in (0, 4)]
    assert [r.total for r in results] == [7, 7]
    pages = [r.page.orderBy("rank").collect() for r in results]
    shown = [r["id"] for p in pages for r in p]
    assert len(shown) == len(set(shown)) == 7 and 2 in shown and 1 not in shown
    merged = next(r for p in pages for r in p if r["id"] == 2)
    assert merged["duplicates"] == ["https://h.vn/x/y/a-1.html"] and all("<mark>" in r["snippet"] for p in pages for r in p)


def test_snippets_fall_back(spark):
    df = spark.createDataFrame([(1, "", "x" * 300), (2, None, None)], "id bigint, title string, text string")
    out = {r["id"]: r["snippet"] for r in S.snippets(df, "học").collect()}
    assert out == {1: "x" * 220 + "…", 2: ""}


def test_postings_have_positions(spark, docs):
    p = {(r["field"], r["term"], r["id"]): r["positions"] for r in docs.postings.collect()}
    assert p["text", "học", 7] == [0, 2, 4] and p["text", "bổng", 4] == [0] and p["text_kd", "bong", 7] == [1, 3, 5]
    empty = I.build(I.documents(spark.createDataFrame([], SCHEMA)))
    assert empty.postings.count() == 0 and S.ranked(empty, S.SearchParams("học")).count() == 0 and S.search(empty, S.SearchParams("học")).total == 0
