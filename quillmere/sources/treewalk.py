"""A file tree as a Spark data source.

Spark's own file sources hide names that begin with a dot or an underscore and enter every directory; this one keeps
the former and prunes ignored directories. The upper levels are listed when the scan is planned, until there are enough
directories to walk in parallel, by whichever executor sees the tree; errors are rows with a status.

Conditions on path, name, kind, depth and size are decided in the walk: what they leave out makes no row, files are only
asked for their size once the other conditions hold, and directories below which nothing can hold aren't opened. Such a
directory's status is ok, whether or not it could have been opened. Conditions are given to tree_entries. They don't come from
Spark's own pushdown into Python sources: in Spark 4.1 all scans of one DataFrame share its reader, so that
a union of two filters of it reads the rows of one of them twice.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmere.functions.catalogs import IGNORED_DIRS

SCHEMA = "path string, name string, kind string, depth int, size long, status string, message string"


#: Directories that are walked in parallel, as far as the tree has them; entries that planning lists at most for that; and
#: listed entries of a partition.
WALKS, PLANNED, LISTED = 128, 20_000, 1000


class Below(InputPartition):
    """Entries (relative path, whether a directory) that are told themselves, and directories that are walked."""

    def __init__(self, listed: list[tuple[str, bool]], walked: list[str]) -> None:
        self.listed, self.walked = listed, walked


#: What a condition says of a value; none holds for an unknown size.
TESTS: dict[str, Callable] = {
    "=": lambda x, v: x == v, "<>": lambda x, v: x != v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "in": lambda x, v: x in v,
    "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v), "contains": lambda x, v: v in x,
}
TESTED = ("path", "name", "kind", "depth", "size")
Condition = tuple[str, str, object]  # column, test, value


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("path") or options["root"]
        self.ignored = {n.lower() for n in (options["ignored"].split(",") if options.get("ignored") else IGNORED_DIRS)}
        self.only: dict[str, list[tuple[str, object]]] = {c: [] for c in TESTED}
        for column, test, value in json.loads(options.get("only") or "[]"):
            if column not in TESTED or test not in TESTS:
                raise ValueError(f"no condition {test!r} on {column!r}")
            self.only[column].append((test, value))

    def holds(self, column: str, x: object) -> bool:
        return all(x is not None and TESTS[test](x, v) for test, v in self.only[column])

    def wanted(self, relative: str, kind: str) -> bool:
        """By all but the size."""
        return self.holds("path", relative) and self.holds("name", os.path.basename(relative)) and self.holds("kind", kind) and self.holds("depth", relative.count("/") + 1)

    def opens(self, relative: str) -> bool:
        """Whether an entry below a directory can hold by its depth and path; the root is always opened."""
        if not relative:
            return True
        depth, below = relative.count("/") + 1, relative + "/"
        deeper = {"=": lambda v: v > depth, "<=": lambda v: v > depth, "<": lambda v: v > depth + 1, "in": lambda v: any(x > depth for x in v)}
        within = {"=": lambda v: v.startswith(below), "in": lambda v: any(x.startswith(below) for x in v), "starts": lambda v: v.startswith(below) or below.startswith(v)}
        return all(can[test](v) for can, column in ((deeper, "depth"), (within, "path")) for test, v in self.only[column] if test in can)

    def children(self, relative: str) -> list[tuple[str, bool]]:
        with os.scandir(os.path.join(self.root, relative)) as entries:
            found = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
        return [(f"{relative}/{n}" if relative else n, d) for n, d in found if not (d and n.lower() in self.ignored)]

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        listed: list[tuple[str, bool]] = []
        walked: deque[str] = deque()
        opened: deque[str] = deque([""])
        while opened and len(opened) + len(walked) < WALKS and len(listed) < PLANNED:
            directory = opened.popleft()
            if not self.opens(directory):
                listed.append((directory, True))
                continue
            try:
                below = self.children(directory)
            except OSError:
                walked.append(directory)  # the walk tells why
                continue
            if directory:
                listed.append((directory, True))
            listed += [c for c in below if not c[1] and self.wanted(c[0], "file")]
            opened += [name for name, is_dir in below if is_dir]
        parts = [Below(listed[i : i + LISTED], []) for i in range(0, len(listed), LISTED)] + [Below([], [d]) for d in (*walked, *opened)]
        return parts or [Below([], [])]

    def read(self, partition: Below) -> Iterator[tuple]:
        for relative, is_dir in partition.listed:
            yield from self.rows(relative, is_dir)
        stack = [(d, True) for d in partition.walked]
        while stack:
            relative, is_dir = stack.pop()
            below = []
            if is_dir and self.opens(relative):
                try:
                    below = self.children(relative)
                except OSError as e:
                    yield from self.rows(relative, True, "walk_failed", str(e))
                    continue
            yield from self.rows(relative, is_dir)
            stack += reversed(below)

    def rows(self, relative: str, is_dir: bool, status: str = "ok", message: str | None = None) -> Iterator[tuple]:
        """A row, or none if a filter leaves it out."""
        kind, size = "directory" if is_dir else "file", None
        if not self.wanted(relative, kind):
            return
        if not is_dir:
            try:
                size = os.stat(os.path.join(self.root, relative)).st_size
            except OSError as e:
                status, message = "stat_failed", str(e)
        if self.holds("size", size):
            yield relative, os.path.basename(relative), kind, relative.count("/") + 1, size, status, message


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treewalk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(dict(self.options))


def tree_entries(spark: SparkSession, root: str, only: Sequence[Condition] = ()) -> DataFrame:
    """The entries below root for which all conditions (column, test, value) hold, such as ("name", "ends", ".py")."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("treewalk").option("root", root).option("only", json.dumps(list(only))).load()


def contents(files: DataFrame, root: str) -> DataFrame:
    """path, content, status of the files that are left after any filter on path or size: contents are read last."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        out.append((path, f.read(), "ok"))
                except OSError:
                    out.append((path, None, "read_failed"))
            yield pd.DataFrame(out, columns=["path", "content", "status"])

    return files.where("kind = 'file'").select("path").mapInPandas(run, "path string, content binary, status string")


def texts(read: DataFrame, policy: str = "replace") -> DataFrame:
    """contents with text: undecodable bytes are replaced, dropped (ignore) or make the text null (strict); binary
    contents, by a zero in the first 4096 bytes, have no text."""
    from pyspark.sql import functions as F

    from quillmere.functions.columns import looks_binary

    content = F.col("content").cast("string")
    # what the file really has of U+FFFD is written otherwise while the undecodable bytes become U+FFFD and are dropped
    apart = F.replace(F.replace(content, F.lit("\x01"), F.lit("\x01a")), F.lit("\ufffd"), F.lit("\x01b"))
    dropped = F.replace(F.make_valid_utf8(apart), F.lit("\ufffd"), F.lit(""))
    ignored = F.replace(F.replace(dropped, F.lit("\x01b"), F.lit("\ufffd")), F.lit("\x01a"), F.lit("\x01"))
    decoded = {"replace": F.make_valid_utf8(content), "ignore": ignored, "strict": F.try_validate_utf8(content)}[policy]
    binary = looks_binary(F.col("content"))
    return read.withColumn("is_binary", binary).withColumn("text", F.when(~binary, decoded))
