"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir. What is below <folder>/quillmere can be deleted once a result
    has been read. Where none is set, a local session takes a temporary folder, and a cluster is an error: its executors
    share no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillmere/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table there, read again: it cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_key(df: DataFrame, key: str, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """written(), with the rows of a key in one of as many buckets as a shuffle has partitions: joins on the key don't shuffle
    the table. Its name in the catalog goes with a call of what is returned beside it, before which all joins must have run."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"quillmere_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE {table}")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written table, and its number of rows, which is counted while it is written."""
    told = Observation()
    table = written(df.observe(told, F.count(F.lit(1)).alias("n")), name)
    return table, told.get["n"]


#: Rows of the input for each partition of a shuffle.
ROWS_EACH = 200_000


def written_by_size(df: DataFrame, name: str, rows: int) -> DataFrame:
    """written(), with shuffles of as many partitions as an input of that many rows takes, if the session has fewer, which Spark
    doesn't join again: so what a task sorts and groups doesn't grow with the input."""
    conf, keys = df.sparkSession.conf, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [conf.get(k) for k in keys]
    if rows <= int(before[0]) * ROWS_EACH:
        return written(df, name)
    try:
        for k, v in zip(keys, (str(-(-rows // ROWS_EACH)), "false"), strict=True):
            conf.set(k, v)
        return written(df, name)
    finally:
        for k, v in zip(keys, before, strict=True):
            conf.set(k, v)


#: Rows of a few numbers that are broadcast at most: some tens of MB.
FEW_ROWS = 300_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df, a written table of a few numbers a row, to be broadcast if a count shows that it is small; else as it is, so a
    join shuffles both sides."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df
