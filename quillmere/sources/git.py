"""Results of git queries as rows: saved output is parsed by Spark; a reader for the driver's machine is optional."""

from __future__ import annotations

import shutil
import subprocess
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitResult(NamedTuple):
    rows: DataFrame | None  # line, ord
    status: str  # ok, git_unavailable or git_query_failed


def git_lines(spark: SparkSession, root: str, *arguments: str, seconds: int = 60) -> GitResult:
    """Lines of one git query, run on the driver: small results only, such as changed names."""
    if not shutil.which("git"):
        return GitResult(None, "git_unavailable")
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=seconds, check=False)
    if done.returncode:
        return GitResult(None, "git_query_failed")
    return GitResult(spark.createDataFrame(list(enumerate(done.stdout.splitlines())), "ord int, line string").select("line", "ord"), "ok")


def changed_paths(lines: DataFrame, line: str = "line") -> DataFrame:
    """path of name-only output: unquoted, portable, once each."""
    plain = F.regexp_replace(F.replace(F.regexp_replace(F.trim(F.col(line)), '^"|"$', ""), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return lines.select(plain.alias("path")).where("path <> ''").distinct()


def status_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """index, worktree, path of porcelain status lines; of a rename the new path."""
    x = F.col(line)
    return lines.where(F.length(x) > 3).select(F.substring(x, 1, 1).alias("index"), F.substring(x, 2, 1).alias("worktree"), F.regexp_replace(F.substring(x, 4, 2**31 - 1), "^.* -> ", "").alias("path"))


def shortstat(lines: DataFrame, line: str = "line") -> DataFrame:
    """files, insertions, deletions of short statistics; what a line leaves out is 0."""
    n = lambda what: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.col(line), rf"(\d+) {what}", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    return lines.where(F.col(line).rlike("file")).select(n("files? changed").alias("files"), n("insertion").alias("insertions"), n("deletion").alias("deletions"))


def commit_delta(local: DataFrame, remote: DataFrame, commit: str = "commit") -> DataFrame:
    """One row, ahead and behind: commits that only one side has."""
    a, b = local.select(commit).distinct(), remote.select(commit).distinct()
    ahead = a.join(b, commit, "left_anti").agg(F.count(F.lit(1)).alias("ahead"))
    return ahead.crossJoin(b.join(a, commit, "left_anti").agg(F.count(F.lit(1)).alias("behind")))  # one row each
