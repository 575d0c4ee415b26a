"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

A map task is a memtable: it sorts its digests and flushes them as one Parquet file, a run (level 0). Compaction
merges all runs into level 1: one row for each digest with the identifier that stays and the number of entries. Both
levels have filters: bitmaps of a bounded size with a bit for every digest that they hold, so that most look-ups that
find nothing, and most texts that are no copies, end in the map task that reads them.

Digests with more than one entry are hits. The filter of the hits is probed where texts are read, so only texts that
may be hits are moved; they are compared byte by byte (the smallest and the largest text of a digest must be the
same), and a digest that two different texts share is resolved by the texts themselves.

Skew: groups are combined inside the map tasks first, so a text that a third of all rows share becomes one row a task,
and the join of entries with hits is salted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEEPS = {"smallest": F.min, "largest": F.max}


def ascii_folded(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; lower() does the same, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Level 0 runs and a level 1 table under one path; documents can be flushed in any number of batches.

    keep says whether compaction keeps the smallest or the largest identifier of a digest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest") -> None:
        if keep not in KEEPS:
            raise ValueError("keep is smallest or largest")
        self.spark, self.path, self.least = spark, path or common.scratch(spark, "digest-index"), KEEPS[keep]

    def flush(self, entries: DataFrame) -> None:
        """entries: digest binary, ident long. Appends sorted runs."""
        entries.select("digest", "ident").sortWithinPartitions("digest", "ident").write.mode("append").parquet(f"{self.path}/level0")

    def runs(self) -> DataFrame:
        return self.spark.read.schema("digest binary, ident long").parquet(f"{self.path}/level0")

    def compact(self) -> DataFrame:
        """digest, keep, size: rewritten from all runs."""
        merged = self.runs().groupBy("digest").agg(self.least("ident").alias("keep"), F.count(F.lit(1)).alias("size"))
        merged.sortWithinPartitions("digest").write.mode("overwrite").parquet(f"{self.path}/level1")
        return self.level1()

    def level1(self) -> DataFrame:
        return self.spark.read.schema("digest binary, keep long, size long").parquet(f"{self.path}/level1")

    def lookup(self, entries: DataFrame) -> DataFrame:
        """entries with keep and size of their digest, null where the index has none; the index is not changed. The
        filter of level 1 is probed first, so entries that it rules out aren't moved."""
        probed = common.Filter(self.level1(), "digest").probe(entries, "digest")
        found = probed.where("__may").drop("__may").join(self.level1(), "digest", "left")
        nothing = F.lit(None).cast("long")
        return probed.where("not __may").drop("__may").select("*", nothing.alias("keep"), nothing.alias("size")).unionByName(found)


def _groups(rows: DataFrame, keep: str) -> tuple[DigestIndex, common.Filter, DataFrame, DataFrame | None]:
    """Of rows (ident, norm, digest): the index, the filter of its hits, the hits, and of digests that different texts
    share digest, norm, keep and size; None if there are none, as is to be expected."""
    index = DigestIndex(rows.sparkSession, keep=keep)
    index.flush(rows)
    hits = index.compact().where("size > 1")
    filter_ = common.Filter(hits, "digest")
    copies = filter_.probe(rows, "digest").where("__may")
    verified = common.written(copies.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same")), "verified")
    clashes = verified.where("not same").select("digest").join(hits.select("digest"), "digest", "left_semi")
    if clashes.isEmpty():
        return index, filter_, hits, None
    by_text = copies.withColumn("salt", common.salt_of("ident")).join(common.salted(clashes), ["digest", "salt"], "left_semi")
    return index, filter_, hits, common.written(by_text.groupBy("digest", "norm").agg(index.least("ident").alias("keep"), F.count(F.lit(1)).alias("size")), "clashes")


def exact_groups(docs: DataFrame, ident: Column, text: Column, digest: Callable[[Column], Column] = sha256, keep: str = "smallest") -> DataFrame:
    """ident, keep, size, digest for every row of docs.

    Null texts count as empty; rows with one ident count as so many rows of their group and each gets a result row;
    a null ident is kept as a row and never preferred to another; an empty table gives no rows; other columns of docs
    are not read, so their names can't clash.
    """
    rows = docs.select(ident.cast("long").alias("ident"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    index, _, hits, parted = _groups(rows, keep)
    salt = common.salt_of("ident")
    out = index.runs().withColumn("salt", salt).join(common.salted(hits), ["digest", "salt"], "left")
    if parted is None:
        return _result(out)
    clashing = common.salted(parted.select("digest").distinct())
    by_text = rows.withColumn("salt", salt).join(common.salted(parted), ["digest", "norm", "salt"]).drop("norm")
    return _result(out.join(clashing, ["digest", "salt"], "left_anti")).unionByName(_result(by_text))


def _result(df: DataFrame) -> DataFrame:
    return df.select("ident", F.coalesce("keep", "ident").alias("keep"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the folded text).

    keep: whether the smallest or the largest doc_id of equal texts stays. Rows that repeat one doc_id are one
    document: they are all kept if that doc_id stays.
    """
    groups = exact_groups(docs, F.col(id_col), ascii_folded(common.text_of(text_col)), keep=keep)
    return groups.select(
        F.col("ident").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("ident").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs, with all their columns, that stay: of equal texts that with the smallest or largest doc_id,
    once, even if it is repeated (then the least row in the order of the columns). Rows that the filter of the hits rules out
    are passed on where they are; only the others are moved."""
    id_, text = F.col(id_col), ascii_folded(common.text_of(text_col))
    keyed = docs.withColumn("__digest", sha256(text))
    _, filter_, hits, parted = _groups(keyed.select(id_.cast("long").alias("ident"), text.alias("norm"), F.col("__digest").alias("digest")), keep)
    probed = filter_.probe(keyed, "__digest")
    maybe = probed.where("__may").withColumn("__norm", text)
    winners, keys = hits.select("digest", "keep", F.lit(None).cast("string").alias("norm")), ["__digest"]
    if parted is not None:
        keys = ["__digest", "__norm"]
        winners = winners.join(parted.select("digest").distinct(), "digest", "left_anti").unionByName(parted.select("digest", "keep", "norm"))
    # of each doc_id with a digest the least row, combined in the map tasks, so copies are a row a task
    one = maybe.groupBy(*keys, F.col(id_col).alias("__id")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    same = F.col("__digest") == F.col("digest")
    if parted is not None:
        same = same & (F.col("norm").isNull() | (F.col("norm") == F.col("__norm")))
    joined = one.join(winners, same, "left")
    kept = joined.where(F.col("digest").isNull() | F.col("__id").cast("long").eqNullSafe(F.col("keep"))).select("__row.*")
    return probed.where("not __may").select(docs.columns).unionByName(kept)
