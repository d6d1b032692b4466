"""Articles and cards, recent listings, budgets, packs, tables, index runs."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import articles as R
from webloom.operators import frontier as L
from webloom.operators import index as I
from webloom.operators import pipeline as P
from webloom.operators import search as S
from webloom.sources import rawstore as W
from webloom.sources import tables as D

PAGE = (
    "<meta property='article:section' content='Tin'><h1>Tiêu đề</h1><span class=h5>Chủ nhật - 09/08/2026 13:40</span><div class=hometext>Lời dẫn</div><ul><li itemprop=itemListElement><b itemprop=name>Trang chủ</b></li></ul>"
    "<div class=bodytext><p>Đoạn một.</p><img src=/i.jpg><a href=/t.PDF>Tệp</a><a href=/x.html>Khác</a><p>Tác giả: Lê A</p></div><meta itemprop=dateModified content=2026-08-10>"
)


def test_article_of_17_fields():
    a = R.article(PAGE, "https://h.vn/vi/tin-7.html", "h.vn", "2026-09-01T00:00:00")
    assert tuple(a) == R.FIELDS and len(R.FIELDS) == 17 and len(R.CSV) == 13
    assert (a["id"], a["lang"], a["title"], a["section"], a["author"], a["published_at"], a["modified_at"]) == ("7", "vi", "Tiêu đề", "Tin", "Lê A", "2026-08-09T13:40:00", "2026-08-10")
    assert a["summary"] == "Lời dẫn" and a["content"] == "Đoạn một. Tệp Khác" and a["word_count"] == 4 and a["breadcrumb"] == ["Trang chủ"]
    assert a["images"] == ["https://h.vn/i.jpg"] and a["attachments"] == ["https://h.vn/t.PDF"] and a["crawled_at"] == "2026-09-01T00:00:00"
    empty = R.article("", "https://h.vn/en/x", "h.vn")
    assert empty["id"] == "https://h.vn/en/x" and empty["lang"] == "en" and empty["title"] == "" and empty["author"] is None and empty["published_at"] is None
    assert R.article("<div class=bodytext>" + "chữ " * 200, "u", "h.vn")["summary"].endswith("…") and R.moment("31/02/2026") is None


def test_cards():
    card = "<div class=panel-body><h2><a href={0} title='{1}'>x</a></h2><img src=/t.jpg><span class=text-muted>18/08/2026 16:30 Đã xem: 1.234</span></div>"
    html = "<div class=news_column>" + card.format("/a-1.html", "Tin A") + card.format("/a-1.html", "lại") + "<div class=panel-body>không</div>" + "</div>" + card.format("/b-2.html", "ngoài")
    assert R.cards(html, "https://h.vn/tin/") == [{"url": "https://h.vn/a-1.html", "title": "Tin A", "date": "2026-08-18T16:30:00", "views": 1234, "thumbnail": "https://h.vn/t.jpg"}]
    items = R.cards("<ul><li><a href=/c-3.html>Tin C</a> 01/02/2024<li>trống</ul>", "https://h.vn/")
    assert [(c["url"], c["date"], c["views"]) for c in items] == [("https://h.vn/c-3.html", "2024-02-01T00:00:00", None)] and R.cards("", "https://h.vn/") == []


def test_recent_links_stop_at_the_first_old_card(spark):
    dates = {1: ["2024-03-01", "2024-02-01", ""], 2: ["2024-01-15", "2023-12-01", "2023-11-01"], 3: ["2024-01-10"]}
    rows = [("a", p, i, f"https://h.vn/{p}{i}-{p}{i}.html", d) for p, ds in dates.items() for i, d in enumerate(ds)]
    pinned = [("b", 1, 0, "https://h.vn/p-90.html", "2020-01-01"), ("b", 1, 1, "https://h.vn/q-91.html", "2024-01-05"), ("b", 2, 0, "https://h.vn/r-92.html", "2024-01-01"), ("b", 2, 1, "https://h.vn/s-93.html", "2030-01-01")]
    cards = spark.createDataFrame(rows + pinned, "listing string, page_no int, pos int, url string, date string")
    got = L.recent_links(cards, "2024-01-01", "2024-12-31")
    assert sorted((r["listing"], r["page_no"], r["pos"]) for r in got.collect()) == [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("b", 1, 1), ("b", 2, 0)]
    queued = spark.createDataFrame([("10-10.html",)], "key string")
    front = L.queue_recent(got, queued, "h.vn", 3).collect()
    assert {r["url"][-8:] for r in front} == {"11-11.html"[-8:], "20-20.html"[-8:]} and all(r["front"] and r["via"] == "recent" for r in front)
    assert L.recent_links(cards.limit(0), "2024-01-01", "2024-12-31").count() == 0


def test_budget_state_and_resume(spark, tmp_path):
    rows = [(f"https://h.vn/{i}.html", f"k{i}", i % 3, "seed") for i in range(9)]
    state = L.within_budget(spark.createDataFrame(rows, "url string, key string, depth int, via string"), 4)
    L.save_state(state, str(tmp_path / "s"))
    extra = spark.createDataFrame([("https://h.vn/new.html",), ("https://h.vn/new.html",), ("bad",)], "url string")
    done, frontier = L.resume(spark, str(tmp_path / "s"), extra)
    assert done.count() == 4 and frontier.count() == 6 and frontier.where("via = 'file'").count() == 1 and done.agg(F.max("depth")).first()[0] == 1


def test_packs(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    for k in range(3):
        (root / f"pages-{k}.jsonl").write_text('{"url": "https://h.vn/%d"}\n' % k)
    told = spark.createDataFrame(W.pack_manifest(spark, str(root)).collect())
    assert {r["state"] for r in W.verify_pack(spark, str(root), told).collect()} == {"ok"}
    assert W.import_pack(spark, str(root), str(tmp_path / "in"), told).count() == 3
    assert [r["part"] for r in W.split_pack(told, 40).orderBy("path").collect()] == [0, 0, 1]
    (root / "pages-1.jsonl").write_text("{}\n")
    (root / "pages-9.jsonl").write_text("{}\n")
    assert sorted(r["state"] for r in W.verify_pack(spark, str(root), told).collect()) == ["changed", "extra", "ok", "ok"]
    with pytest.raises(ValueError):
        W.import_pack(spark, str(root), str(tmp_path / "in2"), told)


def test_tables_are_created_once(spark, tmp_path):
    root = str(tmp_path)
    assert sorted(D.init(spark, root)) == sorted(D.SCHEMAS)
    spark.createDataFrame([("a", "h", ["x"], True), ("a", "h", [], False)], D.SCHEMAS["images"]).write.mode("append").parquet(f"{root}/images")
    assert D.init(spark, root) == [] and D.load(spark, root, "images").count() == 2
    assert [tuple(r) for r in D.repeated_keys(D.load(spark, root, "images")).collect()] == [("a", 2)]
    assert P.delete(D.load(spark, root, "images"), spark.createDataFrame([("a",)], "_id string"), "_id").count() == 0


def test_index_runs(spark):
    raw = spark.createDataFrame([(1, "raw", "s", 1, "https://h.vn/a-1.html", 200, "utf-8", "PHA+SOG7jWMgYuG7lW5nIGPhu6dhIHRyxrDhu51uZy48L3A+")], "rec_id bigint, store string, shard string, line_no int, url string, status int, encoding string, html_b64 string")
    files = spark.createDataFrame([("https://h.vn/t.pdf", "h.vn", "pdf", "điểm chuẩn", "ok"), ("https://h.vn/u.pdf", "h.vn", "pdf", "", "ok")], "url string, host string, ext string, text string, status string")
    rows = P.index_rows(None, raw, files, "h.vn")
    assert sorted((r["url"], r["kind"]) for r in rows.collect()) == [("https://h.vn/a-1.html", "page"), ("https://h.vn/t.pdf", "document")]
    index = I.build(I.documents(rows.drop("date_num")))
    assert S.ranked(index, S.SearchParams("điểm chuẩn", "tfidf")).count() == 1
    assert P.index_rows(None, raw, files, "h.vn", limit=1).count() == 1
    for bad in ("x", "records"):
        with pytest.raises(ValueError):
            P.index_rows(None, raw, files, "h.vn", bad)


def test_shared_folder_and_intermediate_tables(spark, tmp_path):
    from webloom.plans import session as M

    with M.intermediate_tables(spark):
        one = M.materialize(spark.range(5))
        assert one.count() == 5
        path = one.inputFiles()[0]
    import os

    assert not os.path.exists(path.removeprefix("file://"))

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://a:7077"})

    with pytest.raises(RuntimeError):
        M.shared_dir(Fake)


def test_skipped_records_and_limits(spark):
    rows = [(1, "https://h.vn/a-1.html", 1, False), (2, "https://h.vn/a-1.html", 2, True), (3, "https://h.vn/a-1.html", 3, False), (4, "https://h.vn/b-2.html", 4, False), (5, "https://h.vn/c-3.html", 5, True), (6, "https://h.vn/x/a-1.html", 6, True)]
    df = spark.createDataFrame(rows, "rec_id bigint, norm string, o int, ok boolean")
    assert sorted(r[0] for r in P.skipped(df, ["o"], "ok").collect()) == [1, 4]
    one = P.resolve_entities(df, ["o"], "ok", 1).collect()
    assert [(r["primary_id"], r["aliases"]) for r in one] == [(2, [])]


def test_fetch_outcomes(spark):
    rows = [("a", 1, 500), ("a", 2, None), ("a", 3, 200), ("a", 4, 500), ("b", 1, 500), ("b", 2, 502), ("b", 3, 0), ("b", 4, 200), ("c", 1, 404), ("d", 1, 429), ("d", 2, 503)] + [("e", i, 429) for i in range(9)]
    got = {r["url"]: (r["attempts"], r["waited"], r["outcome"]) for r in L.fetch_outcomes(spark.createDataFrame(rows, "url string, ord int, status int")).collect()}
    assert got == {"a": (3, 6.0, "done"), "b": (3, 14.0, "given up"), "c": (1, 0.0, "done"), "d": (2, 32.0, "open"), "e": (8, 240.0, "given up")}
