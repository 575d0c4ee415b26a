"""Bounded results: the rows that are shown, how many there are, and whether some were left out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import columns as C
from quillmere.functions.globs import path_glob
from quillmere.sources.scratch import written


class Bounded(NamedTuple):
    """rows: at most limit; summary: one row with total, returned and truncated."""

    rows: DataFrame
    summary: DataFrame


def checked(limit: int | None) -> None:
    if limit is not None and limit < 0:
        raise ValueError("a limit is None (no limit) or not negative")


def bounded(df: DataFrame, order: list[Column], limit: int | None) -> Bounded:
    """The first rows of an order; truncated only if something was left out."""
    checked(limit)
    returned = F.count(F.lit(1)) if limit is None else F.least(F.count(F.lit(1)), F.lit(limit).cast("long"))
    summary = df.agg(F.count(F.lit(1)).alias("total"), returned.alias("returned"), (F.count(F.lit(1)) > returned).alias("truncated"))
    rows = df.orderBy(*order)
    return Bounded(rows if limit is None else rows.limit(limit), summary)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first rows of each group with their rank. Map tasks pass on ``limit`` rows of a group at most, so a group of
    any size is no burden to the task that ends it."""
    checked(limit)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= limit)


def group_totals(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys, total, truncated for the same limit."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > limit)


def scan_capped(df: DataFrame, order: list[Column], cap: int | None) -> tuple[DataFrame, DataFrame]:
    """The first rows that a bounded scan would see, and one row with scanned and scan_truncated: another bound than
    that of the output, so another flag."""
    b = bounded(df, order, cap)
    return b.rows, b.summary.select(F.col("returned").alias("scanned"), F.col("truncated").alias("scan_truncated"))


def placed(df: DataFrame, order: list[Column], most: int | None = None, place: str = "place") -> DataFrame:
    """df with each row's place in an order, from 1, or its first ``most`` rows only; no task sorts more than its range.

    Rows are cut into ranges of the order and written. The counts of the ranges before a range, one row each, are a
    prefix sum; with ``most`` only ranges that begin before it are read again. Rows alike in the order follow one another as they may.
    """
    checked(most)
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))
    if most is not None:
        starts = starts.where(F.col("__before") < most)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    rows = ranged.join(F.broadcast(starts), "__range").withColumn(place, F.col("__before") + within).drop("__range", "__before")
    return rows if most is None else rows.where(F.col(place) <= most)


def visit_order(path: str = "path", kind: str = "kind") -> list[Column]:
    """The order of a walk that tells, of each directory, its directories and then its files by name, before it goes down
    into the first of these directories. As NUL is less than any character of a name, parents written with it
    are in the order in which a walk enters them."""
    name = C.file_name(F.col(path))
    parent = F.substring(F.col(path), F.lit(1), F.length(path) - F.length(name) - 1)
    return [F.when(F.length(path) > F.length(name), F.replace(parent, F.lit("/"), F.lit("\0"))).otherwise("").asc(), (F.col(kind) != "directory").asc(), name.asc()]


def find(entries: DataFrame, pattern: str = "*", kind: str | None = "file", max_results: int | None = None, max_depth: int | None = None, max_visited: int | None = None, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Entries (path, kind) whose name or whole path a pattern fits, with their place in the walk, in its order; and one row:
    returned, visited, results_truncated, scan_truncated.

    The walk counts entries of the kind (None: of any) and depth that are asked for and ends after max_visited of them, or as soon
    as one result more than max_results is found; only the bound that ended it is told.
    """
    checked(max_results)
    checked(max_visited)
    seen = entries if kind is None else entries.where(F.col("kind") == kind)
    parts = F.size(F.split(path, "/", -1))
    # files of the directories at the greatest depth are counted, as these are opened, but are no results
    seen = seen if max_depth is None else seen.where((parts <= max_depth) | ((parts == max_depth + 1) & (F.col("kind") != "directory")))
    walked = placed(seen, visit_order(path), None if max_visited is None else max_visited + 1)
    scanned = walked if max_visited is None else walked.where(F.col("place") <= max_visited)
    scanned = scanned if max_depth is None else scanned.where(parts <= max_depth)
    glob = path_glob(pattern)
    hits = scanned.where(C.file_name(F.col(path)).rlike(glob) | F.col(path).rlike(glob))
    if max_results is not None:
        hits = written(hits.orderBy("place").limit(max_results + 1), "found")
        rows = hits.orderBy("place").limit(max_results)
    else:
        rows = hits.orderBy("place")
    limit = F.lit(None).cast("long") if max_results is None else F.lit(max_results).cast("long")
    ended = hits.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    told = walked.agg(F.count(F.lit(1)).alias("all")).crossJoin(F.broadcast(ended))  # one row each
    cut = F.coalesce(F.col("n") > limit, F.lit(False))
    most = F.lit(None).cast("long") if max_visited is None else F.lit(max_visited).cast("long")
    return rows, told.select(F.least("n", limit).alias("returned"), F.when(cut, F.col("last")).otherwise(F.least("all", most)).alias("visited"), cut.alias("results_truncated"), (~cut & F.coalesce(F.col("all") > most, F.lit(False))).alias("scan_truncated"))
