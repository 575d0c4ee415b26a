"""The operators that make sense on a stream: log findings line by line, and usage by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.text import log_signal


def log_findings(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with a signal; nothing is kept between batches. The last lines of a log need its end: not on a stream."""
    return lines.where(log_signal(F.col(line)))


def finding_counts(lines: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", line: str = "value") -> DataFrame:
    """window, line_count, finding_count; rows later than ``late`` are dropped, and their windows forgotten."""
    return lines.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("line_count"), F.count_if(log_signal(F.col(line))).alias("finding_count"))


def usage_by_kind(events: DataFrame, time: str, kind: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window, kind, measured, total, largest; a median needs all rows and is left to batches."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, window), F.col(kind).alias("kind"))
    return rows.agg(F.count(value).alias("measured"), F.sum(value).alias("total"), F.max(value).alias("largest"))
