"""Structured Streaming twins: shards read as they are written, upserts by URL, pacing as a stateful fold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import normalized
from webloom.operators.frontier import CAP, FASTER, RUN, SLOWER
from webloom.sources.rawstore import lines_of, parsed


def record_stream(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    """Records of shards (pages-*.jsonl, gzipped or not) as they appear below root; a broken line ends its shard, as in read_records."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "pages-*.jsonl*").load(root).select("path", "content")
    )
    return parsed(lines_of(files)).drop("store", "shard", "line_no")


def first_seen(records: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each canonical URL once within a watermark on fetched_at; later repeats within the delay are dropped, state older than it goes."""
    rows = records.withColumn("norm", normalized(F.col("url"))).where(F.col("norm").isNotNull()).withColumn("at", F.to_timestamp("fetched_at"))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["norm"])


def hourly(records: DataFrame, late: str = "2 hours") -> DataFrame:
    """Pages and bytes per host and hour of fetching, late records within the watermark included."""
    host = F.regexp_extract(normalized(F.col("url")), "^https://([^/?#:]*)", 1)
    rows = records.withColumn("at", F.to_timestamp("fetched_at")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 hour").alias("hour"), host.alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("bytes"))


def upsert_to(table_path: str, key: str, order: str):
    """A foreachBatch function: the latest row of each key of a batch replaces the table's, into a new version directory.

    Versions are numbered by batch, so a batch run twice writes the same version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max(F.struct(order, F.struct(*batch.columns).alias("r"))).alias("m")).select("m.r.*")
        if batch_id:
            old = spark.read.schema(batch.schema).parquet(f"{table_path}/v={batch_id - 1}")
            latest = old.join(latest.select(key), key, "left_anti").unionByName(latest)
        latest.write.mode("overwrite").parquet(f"{table_path}/v={batch_id}")

    return write


def pacing_stream(responses: DataFrame, base: float = 2.5) -> DataFrame:
    """host, ord, delay after each answer of a stream of answers (host, ord, status): the batch fold with its state kept per host."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay, good = state.get if state.exists else (base, 0)
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        out = []
        for status in rows["status"]:
            if status == 429:
                delay, good = min(delay * SLOWER, CAP), 0
            elif status is not None and status < 400:
                good += 1
                if good >= RUN:
                    delay, good = max(delay * FASTER, base), 0
            out.append(delay)
        state.update((float(delay), int(good)))
        yield pd.DataFrame({"host": key[0], "ord": rows["ord"].to_numpy(), "delay": out})

    return responses.select("host", "ord", "status").groupBy("host").applyInPandasWithState(
        fold, "host string, ord bigint, delay double", "delay double, good int", "append", "NoTimeout"
    )
