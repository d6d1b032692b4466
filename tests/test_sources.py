"""Raw stores with damage, lists, exports, streams."""

import gzip
import json

from pyspark.sql import functions as F

from webloom.sources import rawstore as R
from webloom.streaming import ingest as G


def lines(n, start=0):
    return "".join(json.dumps({"url": f"https://h.vn/{i}", "status": 200, "html_b64": "eA==", "fetched_at": f"2026-01-0{1 + i % 5}T10:00:00", "size": 5}) + "\n" for i in range(start, start + n))


def store(tmp_path):
    d = tmp_path / "data" / "raw"
    d.mkdir(parents=True)
    (d / "pages-0000.jsonl").write_text(lines(3))
    (d / "pages-0001.jsonl.gz").write_bytes(gzip.compress(lines(2, 10).encode()) + gzip.compress(lines(2, 12).encode()))
    whole = gzip.compress("".join(lines(400, 1000 + k * 400) for k in range(3)).encode())
    (d / "pages-0002.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (d / "pages-0003.jsonl").write_text(lines(2, 20) + "{broken\n" + lines(5, 30))
    (d / "pages-0004.jsonl").write_text("")
    (d / "notes.txt").write_text("x")
    return str(tmp_path / "data")


def test_damaged_shards(spark, tmp_path):
    got = {}
    for r in R.read_records(spark, store(tmp_path)).collect():
        got.setdefault(r["shard"], []).append(r["url"])
    assert len(got["pages-0000.jsonl"]) == 3 and len(got["pages-0001.jsonl.gz"]) == 4 and len(got["pages-0003.jsonl"]) == 2
    assert 0 < len(got["pages-0002.jsonl.gz"]) < 1200 and "pages-0004.jsonl" not in got


def test_find_write_and_read_again(spark, tmp_path):
    records = R.read_records(spark, store(tmp_path))
    assert R.find_record(records, ["https://h.vn/11"]).first()["line_no"] == 1
    assert R.prefiltered(R.shard_lines(spark, str(tmp_path)), "h.vn/2").count() >= 2
    out = str(tmp_path / "out")
    R.write_shards(records.limit(7), out, 3)
    assert spark.read.json(out).count() == 7
    assert R.pack_manifest(spark, str(tmp_path / "data")).where("length(sha256) = 64").count() == 5  # empty files have no record


def test_small_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": [{"url": "https://a/", "title": "t", "outgoing_links": [{"url": "u", "text": "x"}]}, {"url": "https://b/"}]}))
    assert [r["pos"] for r in R.read_corpus(spark, str(tmp_path / "c.json")).collect()] == [0, 1]
    (tmp_path / "l.txt").write_text("# c\n\n https://a/ \nhttps://b/\n")
    assert [r["url"] for r in R.read_url_list(spark, str(tmp_path / "l.txt")).collect()] == ["https://a/", "https://b/"]
    xml = "<sitemapindex><sitemap><loc>https://a/s.xml?a=1&amp;b</loc></sitemap></sitemapindex>"
    r = R.sitemap_entries(spark.createDataFrame([(xml,), (None,)], "xml string")).first()
    assert (r["loc"], r["lastmod"], r["is_index"]) == ("https://a/s.xml?a=1&b", None, True)
    df = spark.createDataFrame([("a", 'x "y", z', "q")], "source string, target string, text string")
    R.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode()
    assert text == 'source,target,text\r\na,"x ""y"", z",q\r\n'
    R.write_article_csv(df.coalesce(1), str(tmp_path / "bom"))
    assert next((tmp_path / "bom").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfsource")
    R.write_pages(spark.createDataFrame([("p1", "<p>"), ("p2", "x")], "name string, page string"), str(tmp_path / "pages"))
    assert next((tmp_path / "pages" / "name=p1").glob("*.txt")).read_text() == "<p>\n"


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "pages-0.jsonl").write_text(lines(4) + lines(2))
    stream = G.record_stream(spark, str(root))
    run(G.first_seen(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert spark.table("firsts").select("norm").distinct().count() == spark.table("firsts").count() == 4
    run(G.hourly(stream).writeStream.outputMode("update").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert spark.table("hours").agg(F.sum("pages")).first()[0] == 6
    target = str(tmp_path / "table")
    write = G.upsert_to(target, "url", "fetched_at")
    run(stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c3")).start())
    assert spark.read.parquet(f"{target}/v=0").count() == 4
    write(spark.createDataFrame([("https://h.vn/1",) + (None,) * 13], R.RECORD), 1)
    after = spark.read.parquet(f"{target}/v=1")
    assert after.count() == 4 and after.where("status is null").count() == 1


def test_pacing_stream(spark, tmp_path):
    root = tmp_path / "answers"
    root.mkdir()
    (root / "a.json").write_text("".join(json.dumps({"host": "h", "ord": i, "status": s}) + "\n" for i, s in enumerate([429, 200, 429])))
    answers = spark.readStream.schema("host string, ord bigint, status int").json(str(root))
    run(G.pacing_stream(answers).writeStream.outputMode("append").format("memory").queryName("paces").option("checkpointLocation", str(tmp_path / "c")).start())
    assert [round(r["delay"], 3) for r in spark.table("paces").orderBy("ord").collect()] == [3.75, 3.75, 5.625]
