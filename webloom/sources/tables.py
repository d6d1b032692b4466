"""The record tables: their columns and keys, created where they are missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of records with their columns; _id is every table's key.
SCHEMAS = {
    "pages": "_id string, aliases array<string>, host string, lang string, kind string, title string, title_src string, published_at string, published_at_src string, author string, author_src string, cited_source string, section string,"
    " content struct<text: string, html: string, word_count: int, block: struct<path: string, score: double, method: string>>, raw struct<sha1: string, fetched_at: string>, extractor_version string",
    "links": "_id string, src string, dst string, type string, text string, dst_kind string, count int, src_host string, dst_host string",
    "nav_links": "_id string, host string, dst string, type string, text string, dst_kind string, n_pages bigint, sample_src array<string>",
    "images": "_id string, host string, alts array<string>, is_template boolean",
    "documents": "_id string, host string, ext string, mime string, status string, size bigint, sha1 string, fetched_at string, text string, n_pages int, needs_ocr boolean, encoding_suspect boolean, error string, extractor_version string",
    "templates": "host string, n_pages bigint, fp string, n bigint",
}


def init(spark: SparkSession, root: str) -> list[str]:
    """Creates the tables that don't exist below root, empty; those that do stay as they are. Returns the names of the new ones."""
    made = []
    for name, schema in SCHEMAS.items():
        try:
            spark.read.parquet(f"{root}/{name}").schema
        except AnalysisException:
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
            made.append(name)
    return made


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def repeated_keys(df: DataFrame, key: str = "_id") -> DataFrame:
    """key, n of the keys that several rows have: what a unique index would refuse."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
