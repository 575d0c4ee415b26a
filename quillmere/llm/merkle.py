"""A Merkle manifest of a table: a leaf for each row, a tree for each group, and one over the groups.

A level is one window: rows are parted by group and parent, and an ordered collect_list over the whole frame gives each
row its run, which is both what the parent is made from and what the row's siblings are. One row of a run goes on as the
parent. Levels shrink by the arity, so all of them together cost half as much again as the first. Places within a group
come from range partitions and counts of them, so no group is sorted in one task.

Rows: null fields have an encoding of their own. A null group is a group, and comes first. Rows with equal keys are
ordered by their leaves; equal leaves are interchangeable. Only the fields are read, so extra columns don't matter. Texts never
move: a leaf is made where its row is read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
ARITY = 3


def encoded(value: Column) -> Column:
    """- if null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def group_key(name: str) -> Column:
    """A string that isn't null and sorts nulls first, then by bytes."""
    value = F.col(name).cast("string")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The written table rows(grp, ...) with idx, the place of a row in its group, and n, the size of the group.

    Rows are cut into ranges of (grp, order); the counts of a group in the ranges before are a prefix sum over as many rows as there are
    ranges. Places are counted within a range, so a group of any size is spread over all tasks.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = common.written(tied.repartitionByRange("grp", *order, "__tie").withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("grp", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("grp").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("grp", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("grp")).alias("n"))
    within = F.row_number().over(Window.partitionBy("grp", "__range").orderBy(*order, "__tie"))
    return ranged.withColumn("__row", within).join(starts, ["grp", "__range"]).withColumn("idx", F.col("__before") + F.col("__row") - 1).drop("__range", "__tie", "__before", "__row")


class Levels(NamedTuple):
    levels: list[DataFrame]  # from the leaves up: grp, idx, n, left, right (hashes before and after the node in its run), extra columns on the first
    tops: list[DataFrame]  # of each level: grp, h of groups of which one node is left


def grown(nodes: DataFrame, name: str, arity: int = ARITY) -> Levels:
    """The levels over nodes(grp, idx, n, h, ...). n is the number of nodes of the group on the level."""
    level, levels, tops = common.written(nodes, name), [], []
    while True:
        tops.append(level.where("n = 1").select("grp", "h"))
        most = level.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            levels.append(level.withColumn("left", F.lit("")).withColumn("right", F.lit("")))
            return Levels(levels, tops)
        run = F.collect_list("h").over(Window.partitionBy("grp", F.floor(F.col("idx") / arity)).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        at = (F.col("idx") % arity).cast("int")
        seen = level.withColumn("__run", run)
        seen = seen.withColumn("left", F.array_join(F.slice("__run", F.lit(1), at), "")).withColumn("right", F.array_join(F.slice("__run", at + 2, F.lit(arity)), ""))
        above = F.when(F.col("n") > 1, F.sha2(F.array_join("__run", ""), 256))
        seen = common.written(seen.withColumn("__above", above).drop("__run"), name)
        levels.append(seen.drop("__above"))
        parents = seen.where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        level = common.written(parents.select("grp", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.col("__above").alias("h")), name)


def with_paths(tree: Levels, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes of the first level with their path, an array of (left, right) up to the root, and their subroot. above(grp,
    path, subroot) has the path of each group's top. Paths go down a level by a join with the parents, so each is made
    from its parent's and the work is that of the first level and half as much again."""
    parents = None
    for depth in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[depth]
        top = level.where("n = 1").join(above, "grp")
        if parents is None:
            parents = top
            continue
        known = parents.select("grp", F.col("idx").alias("__parent"), F.col("path").alias("__path"), "subroot")
        below = level.where("n > 1").withColumn("__parent", F.floor(F.col("idx") / arity)).join(known, ["grp", "__parent"])
        below = below.withColumn("path", F.concat(F.array(F.struct("left", "right")), "__path")).drop("__parent", "__path")
        parents = below.unionByName(top)
    return parents


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


class Manifest(NamedTuple):
    rows: DataFrame  # key columns, leaf, other, subroot, path: array of (left, right)
    root: str | None  # None of an empty table


def manifest(leaves: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> Manifest:
    """Of a table of a row for each leaf: leaf, the group's column and those of the order (others stay as they are)."""
    own = common.written(leaves.withColumn("grp", group_key(group)).withColumnRenamed("leaf", "h"), "leaves")
    tree = grown(placed(own, [*order, "h"]), "level", arity)
    subroots = tree.tops[0]
    for tops in tree.tops[1:]:
        subroots = subroots.unionByName(tops)
    names = common.written(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("__name"), "h"), "subroots")
    over = grown(placed(names, ["__name"]), "group-level", arity)
    found = over.tops[-1].first()
    start = names.sparkSession.createDataFrame([("", [], "")], "grp string, path array<struct<left:string,right:string>>, subroot string")
    above = with_paths(over, F.broadcast(start), arity)  # one row
    above = common.written(above.select(F.col("__name").alias("grp"), "path", F.col("h").alias("subroot")), "group-paths")
    rows = with_paths(tree, above, arity).withColumnRenamed("h", "leaf").drop("grp", "idx", "n", "left", "right")
    return Manifest(rows, found["h"] if found else None)


def merkle_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", arity: int = ARITY) -> DataFrame:
    """key, leaf, subroot, root, path, proof_sha256, folded_root, verified of every row. ``changed`` gives what has become of
    fields since: the folded root is made of the changed row's leaf and the first siblings, so a row that was changed doesn't
    verify. The proof's digest is that of all siblings, level by level to the root, from left to right."""
    now = [(changed or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(F.col(key), F.col(group), leaf_of([F.col(f) for f in fields]).alias("leaf"), leaf_of(now).alias("__now"))
    made = manifest(leaves, group, [key], arity)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = made.rows.withColumn("root", F.lit(made.root)).withColumn("folded_root", folded(F.col("__now"), F.col("path")))
    return rows.select(key, "leaf", "subroot", "root", "path", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """Without its line ends where 2 divides the CRC-32 of the decimal key; a null text stays."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
