"""Sessions, table access and materialisation in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "webloom", master: str | None = None, shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the plans expect: UTC, adaptive execution, Arrow transfer; shared: the folder all executors share."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan gives far fewer partitions than there are cores: a few small files under heavy work.

    Rows and results are the same; larger inputs have partitions enough and stay as they are, with no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "Join" in plan or "Aggregate" in plan or "Exchange" in plan or "Python" in plan or "InPandas" in plan:
        return df
    return df if 2 * df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session that names none gets one of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="webloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read back.

    It cuts the lineage and outlives lost executors; the files go with the intermediate_tables block they were written in, or when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    where, files = _located(spark, path)
    files.deleteOnExit(where)
    for written in _OPEN:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written in each intermediate_tables block that is open.
_OPEN: list[list[str]] = []


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_table(spark: SparkSession, path: str) -> None:
    where, files = _located(spark, path)
    files.delete(where, True)


@contextmanager
def intermediate_tables(spark: SparkSession, keep: list[str] | None = None) -> Iterator[None]:
    """Drops what was materialised inside the block at its end, but for paths in keep: for results that are written or collected in it."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield
    finally:
        _OPEN.remove(written)
        for path in written:
            if path not in (keep or []):
                drop_table(spark, path)


def table_version(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Changes whenever files of the tables do: their paths, sizes and times."""
    found = []
    for name in names:
        where, files = _located(spark, f"{sf_dir}/{name}.parquet")
        todo = [where]
        while todo:
            for s in files.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                else:
                    found.append(f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}")
    return "\n".join(sorted(found))


#: Stored tables of this application by name and version of their source, oldest first; beyond so many the oldest goes.
_STORES: dict[tuple[str, str, str], tuple[DataFrame | tuple[DataFrame, ...], list[str]]] = {}
STORES_HELD = 8


def stored(spark: SparkSession, sf_dir: str, name: str, sources: list[str], build):
    """What build() made and materialised for these source tables, made once for each version of their files.

    build returns frames over materialised tables; they live in the shared folder until newer stores push them out.
    """
    key = (spark.sparkContext.applicationId, name, table_version(spark, sf_dir, sources))
    if key not in _STORES:
        own: list[str] = []
        outer, _OPEN[:] = list(_OPEN), [own]  # a store outlives the block that happens to need it first
        try:
            made = build()
        finally:
            _OPEN[:] = outer
        _STORES[key] = (made, own)
        while len(_STORES) > STORES_HELD:
            gone = next(iter(_STORES))
            for path in _STORES.pop(gone)[1] if gone[0] == key[0] else []:
                drop_table(spark, path)
    return _STORES[key][0]


def forget(spark: SparkSession, sf_dir: str, name: str, sources: list[str]) -> None:
    """Drops a stored table, so that the next use builds it anew."""
    for path in _STORES.pop((spark.sparkContext.applicationId, name, table_version(spark, sf_dir, sources)), (None, []))[1]:
        drop_table(spark, path)
