"""Raw stores on disk: sharded JSON lines, plain or gzipped, possibly damaged; and small list sources."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.frames import safe
from webloom.functions.urls import normalized, python_norm

RECORD = (
    "url string, final_url string, status int, content_type string, kind string, article_id string, depth int, via string, fetched_at string, size bigint, sha1 string,"
    " encoding string, rendered boolean, html_b64 string"
)


def inflate(data: bytes) -> bytes:
    """Everything readable of a gzip file of one or several members; a truncated one gives what was read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        try:
            out.append(reader.decompress(data) + reader.flush())
        except zlib.error:
            break
        if not reader.eof:
            break
        data = reader.unused_data
    return b"".join(out)


def whole(line: str) -> bool:
    """Whether a line is one JSON object."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def shard_lines(spark: SparkSession, root: str) -> DataFrame:
    """store, shard, line_no, line of all pages-*.jsonl[.gz] below root, up to the first broken line of each shard.

    One shard is one task's work, as gzip can't be split. Writers keep shards small (200 records a shard); binaryFile reads up to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "pages-*.jsonl*").load(root).select("path", "content")
    return lines_of(files)


def lines_of(files: DataFrame) -> DataFrame:
    """shard_lines of files given as path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                text = (inflate(content) if path.endswith(".gz") else bytes(content)).decode("utf-8", "replace")
                parts = path.split("/")
                lines = list(takewhile(whole, filter(str.strip, text.split("\n"))))
                yield pd.DataFrame({"store": parts[-2], "shard": parts[-1], "line_no": range(len(lines)), "line": lines})

    return files.mapInPandas(safe(run), "store string, shard string, line_no int, line string")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of all shards. A broken line ends its shard: it and what follows in that shard are left out."""
    return parsed(shard_lines(spark, root))


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select("store", "shard", "line_no", F.from_json("line", RECORD).alias("r")).select("store", "shard", "line_no", "r.*")


def prefiltered(rows: DataFrame, paths: list[str], column: str = "line") -> DataFrame:
    """Rows that can hold a URL with one of the paths, as it is or escaped: a cheap test before JSON is parsed or a URL normalised."""
    found = F.lit(False)
    for p in paths:
        found = found | F.col(column).contains(p) | F.col(column).contains(json.dumps(p)[1:-1])
    return rows.where(found)


def find_record(records: DataFrame, urls: list[str]) -> DataFrame:
    """The first record, in the order of stores, shards and lines, that has one of the given URLs, in any spelling of it.

    The last segments of their paths stand in every spelling; the test for them reaches the scan.
    """
    wanted = sorted({n for u in urls if (n := python_norm(u, ""))})
    last = sorted({u.partition("?")[0].rsplit("/", 1)[1] if u.count("/") > 2 else "" for u in wanted})
    return prefiltered(records, last, "url").where(normalized(F.col("url")).isin(wanted)).orderBy(*[c for c in ("store", "shard", "line_no", "rec_id") if c in records.columns]).limit(1)


def write_shards(records: DataFrame, path: str, size: int = 200, mode: str = "append") -> None:
    """Gzipped JSON lines, so many records a shard at most."""
    records.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", size).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON corpus files ({documents: […]}), with their position."""
    shape = (
        "documents array<struct<url: string, title: string, content: string, host: string, section: string, published_at: string, author: string, kind: string,"
        " outgoing_links: array<struct<url: string, text: string>>>>"
    )
    return spark.read.schema(shape).json(path, multiLine=True).select(F.posexplode("documents").alias("pos", "d")).select("pos", "d.*")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of the lines of a list; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def sitemap_entries(xml: DataFrame, column: str = "xml") -> DataFrame:
    """loc, lastmod, is_index of sitemap texts, whether index or flat."""
    body = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    rows = xml.select(F.explode(body).alias("e"), F.col(column).contains("<sitemapindex").alias("is_index"))
    g = lambda tag: F.regexp_extract("e", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    return rows.select(F.replace(g("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), F.nullif(g("lastmod"), F.lit("")).alias("lastmod"), "is_index").where("loc <> ''")


def unseen_urls(queued: DataFrame, listed: DataFrame) -> DataFrame:
    """Queued URLs that a list doesn't have yet, once and in order."""
    return queued.select("url").distinct().join(listed.select("url").distinct(), "url", "left_anti").orderBy("url")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, minimal quoting with doubled quotes, lines ending in CR LF."""
    df.write.mode(mode).option("header", "true").option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_article_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that spreadsheets open as UTF-8: the first column's name begins with a byte order mark."""
    write_csv(df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]), path, mode)


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text file per page (columns name, page), written by the executors under the page's name."""
    pages.select("name", "page").repartition("name").write.mode(mode).partitionBy("name").option("lineSep", "\n").text(path)


def pack_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_pack(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """path, state of a pack's files below root against its manifest (paths ending alike): ok, changed, missing or extra."""
    name = lambda df: df.withColumn("name", F.regexp_extract("path", "([^/]+/[^/]+)$", 1))
    here, told = name(pack_manifest(spark, root)).select("name", "sha256"), name(manifest).select("name", F.col("sha256").alias("told"))
    state = F.when(F.col("told").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("told") == F.col("sha256"), "ok").otherwise("changed")
    return here.join(told, "name", "full_outer").select(F.col("name").alias("path"), state.alias("state"))


def split_pack(manifest: DataFrame, most_bytes: int) -> DataFrame:
    """manifest with part: files in the order of their paths, in parts that begin anew every so many bytes."""
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    return manifest.withColumn("part", F.floor(before / most_bytes).cast("int"))


def import_pack(spark: SparkSession, source: str, target: str, manifest: DataFrame) -> DataFrame:
    """Copies the shards of a verified pack below target and returns their records; a pack with missing or changed files is refused."""
    wrong = verify_pack(spark, source, manifest).where("state in ('missing', 'changed')")
    if not wrong.isEmpty():
        raise ValueError(f"damaged: {[r['path'] for r in wrong.limit(5).collect()]}")
    records = read_records(spark, source)
    write_shards(records, target, mode="append")
    return records
