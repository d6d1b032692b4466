"""Rules of tables; one page written again."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import pipeline as P
from webloom.operators import validation as V


def test_violations(spark):
    block = F.struct(F.struct(F.lit("heuristic").alias("method")).alias("block"), F.lit(3).alias("word_count"))
    pages = spark.createDataFrame([("u", "h", "t", "vi", "2026-09-05"), ("u2", "h", None, "vi", ""), ("u3", "h", "t", "xx", "05/09/2026")], "_id string, host string, title string, lang string, published_at string").withColumn("content", block)
    assert {tuple(r) for r in V.violations(pages, "pages").collect()} == {("u2", "title"), ("u3", "lang"), ("u3", "published_at")}
    bad = pages.limit(1).withColumn("content", F.struct(F.struct(F.lit("magic").alias("method")).alias("block"), F.lit(-1).alias("word_count")))
    assert {r["rule"] for r in V.violations(bad, "pages").collect()} == {"method", "word_count"}
    links = spark.createDataFrame([("a", "s", "d", "href", "page", 1), ("b", "s", "d", "href", "video", -1), ("c", "", None, None, None, None)], "_id string, src string, dst string, type string, dst_kind string, count int")
    assert {tuple(r) for r in V.violations(links, "links").collect()} == {("b", "dst_kind"), ("b", "count"), ("c", "src"), ("c", "dst"), ("c", "type"), ("c", "dst_kind"), ("c", "count")}
    templates = spark.createDataFrame([("h", 20, "0123456789abcdef", 9), ("h", 20, "x", 30)], "host string, n_pages int, fp string, n int")
    assert {r["rule"] for r in V.violations(templates, "templates").collect()} == {"fp", "n"}
    for name, row, shape in (("nav_links", ("a", "h", "page", 1, ["s"]), "_id string, host string, dst_kind string, n_pages int, sample_src array<string>"), ("images", ("a", True), "_id string, is_template boolean"), ("documents", ("a", "ok", 1, None), "_id string, status string, size bigint, n_pages int")):
        assert V.violations(spark.createDataFrame([row], shape), name).count() == 0


def test_public_documents(spark):
    shape = "row_id bigint, url string, title string, content string, host string, section string, published_at string, author string, kind string"
    rows = [
        (1, "https://www.A.vn/x", "t" * 600, "c", None, None, "2026-01-02T10:00", None, None), (2, "https://www.A.vn/x", "second", "", "", None, None, "b", "page"), (3, "javascript:x", "t", "c", None, None, None, None, None), (4, "https://a/e", "", None, None, None, None, None, None),
        (5, "https://a/d", "t", "c", None, None, "hôm qua", None, None), (6, "https://a/k", "t", "c", None, None, None, None, "video"), (7, "http://b.vn/", None, "x" * 200_500, "B.VN", "s", " ", "a", "document"),
    ]
    df = spark.createDataFrame(rows, shape)
    out = {r["row_id"]: r for r in V.public_documents(df, "row_id").collect()}
    assert set(out) == {2, 7} and (out[2]["sent"], out[2]["host"], out[2]["kind"]) == (2, "a.vn", "page") and len(out[7]["content"]) == 200_000 and out[7]["host"] == "b.vn"
    assert {r["row_id"]: r["rule"] for r in df.select("row_id", V.broken_rule().alias("rule")).where("rule is not null").collect()} == {3: "url", 4: "title or content", 5: "published_at", 6: "kind"}


def test_one_page_again(spark):
    make = lambda rows, shape: spark.createDataFrame(rows, shape)
    page, link, image, file = "_id string, title string", "_id string, src string, dst string", "_id string, host string, alts array<string>, is_template boolean", "_id string, status string"
    tables = {"pages": make([("p", "old"), ("q", "q")], page), "links": make([("1", "p", "x"), ("2", "q", "y")], link), "images": make([("i", "h", ["a"], True)], image), "documents": make([("f", "ok")], file)}
    once = P.write_single(tables, make([("p", "new")], page), make([("3", "p", "z")], link), make([("i", "h", ["b"], False), ("j", "h", [], True)], image), make([("f", "pending"), ("g", "pending")], file))
    twice = P.write_single(once, make([("p", "new")], page), make([("3", "p", "z")], link), make([("i", "h", ["b"], False)], image), make([("g", "pending")], file))
    for t in (once, twice):
        got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in t.items()}
        assert got["pages"] == [("p", "new"), ("q", "q")] and got["links"] == [("2", "q", "y"), ("3", "p", "z")] and got["documents"] == [("f", "ok"), ("g", "pending")]
        assert got["images"] == [("i", "h", ["a", "b"], False), ("j", "h", [], True)]


def test_index_source(spark):
    some, none = spark.range(1), spark.range(0)
    assert P.index_source(some) == "records" and P.index_source(none) == P.index_source(None) == "raw" and P.index_source(none, "records") == "records"
    with pytest.raises(ValueError):
        P.index_source(some, "x")
