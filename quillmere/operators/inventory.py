"""Inventory of files: languages, sizes, roles, priorities and estimates, from path and size alone where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import catalogs
from quillmere.functions import columns as C
from quillmere.operators.bounded import top_per_group
from quillmere.operators.selection import medians


def not_ignored(path: Column, names: Sequence[str] = catalogs.IGNORED_DIRS) -> Column:
    return ~F.arrays_overlap(F.transform(C.directories(path), F.lower), F.array(*map(F.lit, names)))


def stats(files: DataFrame, group: Column, text: str = "text", max_bytes: int | None = None, characters: bool = False) -> DataFrame:
    """group, file_count, line_count, byte_count of the files that are measured; oversized, binary_files counted apart. A file is
    binary by a NUL in its first 4096 bytes; with ``characters``, in as many characters of its text."""
    size = F.octet_length(text)
    oversized = size > max_bytes if max_bytes else F.lit(False)
    sniffed = F.substring(text, 1, 4096).cast("binary") if characters else F.substring(F.col(text).cast("binary"), 1, 4096)
    binary = ~oversized & C.has_nul(sniffed)
    measured = ~oversized & ~binary
    rows = files.where(F.col(text).isNotNull()).select(group.alias("group"), size.alias("size"), oversized.alias("oversized"), binary.alias("binary"), F.when(measured, C.line_count(F.col(text))).alias("lines"))
    ok = F.col("lines").isNotNull()
    return rows.groupBy("group").agg(
        F.count_if(ok).alias("file_count"), F.coalesce(F.sum("lines"), F.lit(0)).alias("line_count"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).cast("long").alias("byte_count"),
        F.count_if("oversized").alias("oversized"), F.count_if("binary").alias("binary_files"),
    )


def summary(files: DataFrame, path: str = "path", size: str = "size", large_bytes: int = 100_000, signals: Mapping[str, Sequence[str]] = catalogs.SUMMARY_SIGNALS) -> DataFrame:
    """One row: file_count, doc_count, test_count, large_count, size_class, project_types, in one pass."""
    p, low = F.col(path), F.lower(path)
    found = [F.bool_or(C.any_of(low.contains(s) for s in words)).alias(f"is_{kind}") for kind, words in signals.items()]
    test = low.rlike("(^|/)tests?/") | C.file_name(low).rlike("^test_|_test[.]|[.]test[.]|[.]spec[.]")
    out = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.count_if(C.is_doc_path(p)).alias("doc_count"), F.count_if(test).alias("test_count"), F.count_if(F.col(size) >= large_bytes).alias("large_count"), *found
    )
    kinds = F.filter(F.array(*(F.when(F.col(f"is_{k}"), F.lit(k)) for k in sorted(signals))), lambda x: x.isNotNull())
    n = F.col("file_count")
    return out.select("file_count", "doc_count", "test_count", "large_count", size_class(n).alias("size_class"), kinds.alias("project_types"))


def size_class(n: Column, complete: Column | None = None) -> Column:
    named = F.when(n < 200, "small").when(n < 2000, "medium").otherwise("large")
    return named if complete is None else F.when(complete, named).otherwise("unknown")


def project_scores(files: DataFrame, path: str = "path", signals: Mapping[str, Sequence[str]] = catalogs.SCORED_SIGNALS) -> DataFrame:
    """type, score: how many of its signals are a part of some path; an equi-join of distinct parts, combined early."""
    rows = [(kind, s.lower()) for kind, words in signals.items() for s in words]
    listed = files.sparkSession.createDataFrame(rows, "type string, part string")
    parts = files.select(F.explode(F.split(F.lower(path), "/", -1)).alias("part")).distinct()
    return parts.join(F.broadcast(listed), "part").groupBy("type").agg(F.count_distinct("part").alias("score"))


def file_role(path: Column) -> Column:
    low, ext = F.lower(path), C.extension(path)
    parts = F.split(low, "/", -1)
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(C.file_name(low).contains("test") | has("tests", "test"), "tests")
        .when(ext.isin(*catalogs.DOC_EXTENSIONS) | has("docs", "doc"), "documentation")
        .when(ext.isin(*catalogs.ROLE_SOURCES), "source")
        .when(ext.isin(*catalogs.ROLE_CONFIGS), "configuration")
        .when(ext.isin(*catalogs.ROLE_ASSETS), "asset_or_binary")
        .otherwise("other")
    )


def role_map(files: DataFrame, path: str = "path", examples: int = 12) -> DataFrame:
    """role, file_count, example_paths (the first in order)."""
    rows = files.select(F.col(path).alias("path"), file_role(F.col(path)).alias("role"))
    shown = top_per_group(rows, ["role"], [F.col("path")], examples).groupBy("role").agg(F.sort_array(F.collect_list("path")).alias("example_paths"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("file_count")).join(shown, "role", "left")


def document_roles(files: DataFrame, path: str = "path", per_role: int = 20, roles: Mapping[str, Sequence[str]] = catalogs.DOCUMENT_ROLES) -> DataFrame:
    """role, path, role_total, role_truncated: documents whose name has a word of a role; a document may have several."""
    name = F.lower(C.file_name(F.col(path)))
    hit = F.filter(F.array(*(F.when(C.any_of(name.contains(w) for w in words), F.lit(role)) for role, words in roles.items())), lambda x: x.isNotNull())
    rows = files.where(C.is_doc_path(F.col(path))).select(F.col(path).alias("path"), F.explode(hit).alias("role"))
    totals = rows.groupBy("role").agg(F.count(F.lit(1)).alias("role_total"))
    return top_per_group(rows, ["role"], [F.col("path")], per_role).drop("rank").join(F.broadcast(totals), "role").withColumn("role_truncated", F.col("role_total") > per_role)


def context_priority(path: Column) -> Column:
    """P0 to P4; well-known names count with their case, directories without."""
    low = F.concat(F.lit("/"), F.lower(path))
    return (
        F.when(C.file_name(path).isin(*catalogs.TOP_NAMES), "P0")
        .when(low.contains("/tests/"), "P2")
        .when(low.contains("/docs/"), "P3")
        .when(C.extension(path).isin(*catalogs.MANIFEST_SOURCES), "P1")
        .otherwise("P4")
    )


def manifest(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """context_priority, path, bytes."""
    return files.select(context_priority(F.col(path)).alias("context_priority"), F.col(path).alias("path"), F.col(size).alias("bytes"))


def manifest_order() -> list[Column]:
    return [F.col("context_priority"), F.col("path")]


def context_budget(files: DataFrame, key: str, size: Column, text: Column | None = None) -> DataFrame:
    """key, bytes, estimated_tokens: from sizes alone, or with text from its characters."""
    estimate = C.token_estimate(F.length(text) if text is not None else size)
    return files.select(F.col(key).alias("key"), size.cast("long").alias("bytes"), estimate.alias("estimated_tokens"))


def budget_order() -> list[Column]:
    return [F.desc("estimated_tokens"), F.desc("bytes"), F.desc("key")]


def hotspots(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """path, bytes, depth."""
    return files.select(F.col(path).alias("path"), F.col(size).cast("long").alias("bytes"), F.size(F.split(path, "/", -1)).alias("depth"))


def hotspot_order() -> list[Column]:
    return [F.desc("bytes"), F.desc("depth"), F.desc("path")]


def responsibility_order() -> list[Column]:
    """Files whose size is known come first."""
    return [F.desc_nulls_last("bytes"), F.desc("path")]


def tree(files: DataFrame, path: str = "path", depth: int = 3) -> DataFrame:
    """path, depth, kind of every prefix of at most ``depth`` parts, directories and files alike, once."""
    parts = F.split(path, "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), F.when(i < F.size(parts), "directory").otherwise("file").alias("kind")))
    return files.select(F.inline(prefixes)).groupBy("path", "depth").agg(F.min("kind").alias("kind"))


def tree_order() -> list[Column]:
    """Directories first, then by name without case, then by path."""
    return [F.col("kind") != "directory", F.lower(F.substring_index("path", "/", -1)), F.col("path")]


def top_directories(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(F.col(path).contains("/")).select(F.substring_index(path, "/", 1).alias("directory")).distinct()


def low_value(files: DataFrame, path: str = "path") -> DataFrame:
    """path, kind, matched_rule: the topmost directory of a low-value name, else the file by its extension; a matched
    directory hides what is below it."""
    parts = F.split(path, "/", -1)
    dirs = F.transform(C.directories(F.col(path)), F.lower)
    hits = F.filter(F.transform(dirs, lambda d, i: F.when(d.isin(*catalogs.LOW_VALUE_DIRS), i + 1)), lambda x: x.isNotNull())
    top = F.get(hits, 0)
    ext = C.extension(F.col(path))
    rows = files.select(
        F.when(top.isNotNull(), F.array_join(F.slice(parts, 1, F.coalesce(top, F.lit(1))), "/")).when(ext.isin(*catalogs.LOW_VALUE_EXTENSIONS), F.col(path)).alias("path"),
        F.when(top.isNotNull(), "directory").otherwise("file").alias("kind"),
        F.when(top.isNotNull(), F.concat(F.lit("directory_name:"), F.get(dirs, top - 1))).otherwise(F.concat(F.lit("extension:"), ext)).alias("matched_rule"),
    )
    return rows.where("path is not null").distinct()


def languages(files: DataFrame, path: str = "path", names: Mapping[str, str] = catalogs.ROUTING_LANGUAGES) -> DataFrame:
    """language, file_count of the files with a known extension."""
    return files.select(C.mapped(C.extension(F.col(path)), names).alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("file_count"))


def language_order() -> list[Column]:
    return [F.desc("file_count"), F.col("language")]


def status_rollup(rows: DataFrame, group: str, status: str = "status") -> DataFrame:
    """group, failed, warned, skipped, total, status: failures before warnings before skips; no status is unknown."""
    s = F.col(status)
    out = rows.groupBy(F.col(group).alias("group")).agg(
        F.count_if(s.isin("failed", "read_failed", "parse_failed")).alias("failed"), F.count_if(s == "ok_with_warnings").alias("warned"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.isNull()).alias("unknown"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("warned") > 0, "ok_with_warnings").when((F.col("skipped") > 0) | (F.col("unknown") > 0), "partial").otherwise("ok"))


def usage_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, total, smallest, largest, mean and median (of an even number the mean of the middle two) of measured
    values, with the number that isn't measured apart. The median is selected in rounds, so groups may be of any size."""
    found = rows.groupBy(*keys).agg(
        F.count(value).alias("measured"), F.count_if(F.col(value).isNull()).alias("unmeasured"), F.sum(value).alias("total"), F.min(value).alias("smallest"), F.max(value).alias("largest"),
        F.avg(value).alias("mean"),
    )
    middle = medians(rows, keys, value).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))
    return found.join(middle, same, "left").drop(*(f"__{k}" for k in keys))


def reduction(base: Column, left: Column) -> Column:
    """Percent saved, to one digit; 0 of nothing."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.round(100.0 * (1 - left / base), 1))
