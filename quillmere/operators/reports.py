"""Reports as one row of Markdown, from bounded rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.bounded import Bounded, bounded


def _joined(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """The lines of bounded rows in an order, as one text."""
    kept = rows.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), line.alias("line")).alias("r"))
    return kept.agg(F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n"), F.lit("")).alias("lines"))


def responsibility_report(files: DataFrame, limit: int = 120) -> DataFrame:
    """report: a table of the largest files (path, bytes) with room for an owner, and how many more there are."""
    shown: Bounded = bounded(files, [F.desc_nulls_last("bytes"), F.desc("path")], limit)
    line = F.concat(F.lit("| `"), F.col("path"), F.lit("` | "), F.coalesce(F.col("bytes").cast("string"), F.lit("unavailable")), F.lit(" | to be told |"))
    # ascending keys that put the largest first and unknown sizes last
    body = _joined(shown.rows, [F.col("bytes").isNull(), -F.coalesce("bytes", F.lit(0)), F.col("path")], line)
    hidden = F.col("total") - F.col("returned")
    one = body.crossJoin(shown.summary)  # one row each
    more = F.when(hidden > 0, F.concat(F.lit("\n\n"), hidden.cast("string"), F.lit(" more files are not shown"))).otherwise("")
    return one.select(F.concat(F.lit("| Path | Bytes | Responsibility |\n|---|---:|---|\n"), "lines", more).alias("report"))


def context_pack(task: Mapping[str, str], changed: DataFrame | None, status: DataFrame | None, limit: int = 60) -> DataFrame:
    """report: goal, requirements, acceptance and what is deferred, with bounded lists of changed(line) and status(line);
    None stands for a query that failed, which is told and is not the same as an empty list."""

    def listed(rows: DataFrame | None, none: str, spark_rows: DataFrame) -> DataFrame:
        if rows is None:
            return spark_rows.select(F.lit("- unavailable").alias("lines"))
        shown = bounded(rows, [F.col("line")], limit)
        body = _joined(shown.rows, [F.col("line")], F.concat(F.lit("- "), "line")).crossJoin(shown.summary)
        return body.select(F.when(F.col("total") == 0, f"- {none}").otherwise(F.concat("lines", F.when(F.col("truncated"), "\n- and more").otherwise(""))).alias("lines"))

    anchor = changed if changed is not None else status
    if anchor is None:
        raise ValueError("a context pack needs the changed files or the status")
    spark_rows = anchor.sparkSession.range(1)
    head = "# Context\n\n" + "\n".join(f"- {k}: {v}" for k, v in task.items())
    a = listed(changed, "none", spark_rows).withColumnRenamed("lines", "changed")
    b = listed(status, "clean", spark_rows).withColumnRenamed("lines", "status")
    return a.crossJoin(b).select(F.concat(F.lit(head + "\n\n## Changed\n"), "changed", F.lit("\n\n## Status\n"), "status").alias("report"))
