"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.timestamps import normalize_timestamps
from webloom.plans.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus row whose published_at names a real moment, with that moment in UTC."""
    return normalize_timestamps(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "sites")).select("row_id", "utc_us")


def p3_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values were read in each format."""
    found = normalize_timestamps(table(spark, sf_dir, "corpus"), table(spark, sf_dir, "sites"))
    return found.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.min("utc_us").alias("first_us"), F.max("utc_us").alias("last_us"))


QUERIES = {"p3_found": p3_found, "p3_formats": p3_formats}
SQL: dict[str, str] = {}
