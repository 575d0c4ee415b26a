"""A structure index as Parquet: versions of nodes and edges, and a manifest that says which one holds."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FORMAT = "structure-index/1"


#: A row of the manifest: number of the version, its folder, and what the index says of itself.
MANIFEST = "number long, version string, format string, input_truncated boolean, input_errors long"


def _published(spark: SparkSession, path: str) -> Row | None:
    """The last row of the manifest, which has one row a version; None before the first one."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("number"), F.desc("version")).first()


def write_index(nodes: DataFrame, edges: DataFrame, path: str, input_truncated: bool = False, input_errors: int = 0) -> None:
    """A new version in a folder of its own. One row added to the manifest publishes it, once both tables are whole: so a
    reader never sees nodes of one build beside edges of another, and a build that fails leaves the last version as it was."""
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    nodes.write.parquet(f"{path}/versions/{version}/nodes")
    edges.write.parquet(f"{path}/versions/{version}/edges")
    last = _published(spark, path)
    row = [((last["number"] if last else 0) + 1, version, FORMAT, input_truncated, input_errors)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """nodes, edges and the manifest's row of the version that was published last; another format, or none at all, raises."""
    last = _published(spark, path)
    if last is None:
        raise ValueError(f"{path} holds no index")
    if last["format"] != FORMAT:
        raise ValueError(f"{path} is of the format {last['format']}, not {FORMAT}")
    return spark.read.parquet(f"{path}/versions/{last['version']}/nodes"), spark.read.parquet(f"{path}/versions/{last['version']}/edges"), last.asDict()


def write_by_language(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("language").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
