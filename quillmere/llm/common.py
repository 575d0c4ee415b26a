"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources.scratch import scratch_path as scratch
from quillmere.sources.scratch import small_or_shuffled, written, written_by_key

__all__ = ["Filter", "Kept", "components", "held_out", "hot_list", "hot_values", "lookup", "salt_of", "salted", "scratch", "sliced", "small_or_shuffled", "spread", "table", "text_of", "written", "written_by_key", "written_in_small_batches"]

#: Splits a digest that a third of all rows may share over so many tasks.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most where rows hold texts, and a batch of Spark's usual size takes tens of MB on either side.
BATCH_ROWS = 500


def written_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """written(), for a step that gives texts to Python and works them row by row: its results don't depend on batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        return written(df, name)
    conf.set(key, str(BATCH_ROWS))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def text_of(column: str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str) -> Column:
    """Rows whose labels are never used for fitting."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salted(df: DataFrame, name: str = "salt") -> DataFrame:
    """Each row once for every salt, for the small side of a salted join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


#: Rows of an Arrow batch that are made Python objects at once, and bytes after which a slice takes no further row.
SLICE, SLICE_BYTES = 1000, 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE, text: int | None = None, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so a worker's memory follows so many texts and not Spark's batch. With the
    place of a text column a slice also ends at the row that brings its texts to ``most_bytes``."""
    for batch in batches:
        if text is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = min(start + rows, int(np.searchsorted(ends, before + most_bytes)) + 1, batch.num_rows)
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


class Kept(dict):
    """What make() gave for a key; the entries of the last two fillings are known, so frequent keys stay."""

    def __init__(self, make: Callable, room: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.before, self.room, self.longest = make, {}, room, longest

    def __missing__(self, key: str):
        made = self.before.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.before = dict(self)
                self.clear()
            self[key] = made
        return made


#: Bits of one row of a filter (what Spark's bitmap functions use), bits for each value, and rows at most: 16 MB.
ROW_BITS, BITS_EACH, FILTER_ROWS = 32_768, 16, 4096


class Filter:
    """A Bloom filter with one hash: rows (bucket, bits) of a bounded number, broadcast to where it is probed."""

    def __init__(self, table_: DataFrame, column: str) -> None:
        """Of the values of a column of a written table."""
        rows = min(FILTER_ROWS, max(1, -(-table_.count() * BITS_EACH // ROW_BITS)))
        self.bits = rows * ROW_BITS
        at = self._place(F.col(column))
        made = table_.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
        self.rows = written(made, "filter")

    def _place(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.bits))

    def probe(self, df: DataFrame, column: str) -> DataFrame:
        """df with __may: false where the value is surely not in the filter. Nothing is shuffled."""
        place = F.bitmap_bit_position(self._place(F.col(column)))
        byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
        probed = df.withColumn("__bucket", F.bitmap_bucket_number(self._place(F.col(column)))).join(F.broadcast(self.rows), "__bucket", "left")
        return probed.withColumn("__may", is_set).drop("__bucket", "__bits")

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """Rows that may have a value of the filter, and the others."""
        probed = self.probe(df, column)
        return probed.where("__may").drop("__may"), probed.where("not __may").drop("__may")


#: Keys that lookup() treats apart at most: those with more than 1 / HOT of all rows, of which there are fewer than HOT.
HOT = 2000
#: Rows that are sampled to find them.
HOT_SAMPLE = 1_000_000


def hot_list(rows: DataFrame, key: str, most: int = HOT) -> list:
    """The values of key that more than one of ``most`` rows has, in a sample of the written table ``rows``; fewer than
    ``most``. Which these are decides only how rows are dealt, never what is found."""
    total = rows.count()
    sampled = rows.select(key) if total <= HOT_SAMPLE else rows.select(key).sample(HOT_SAMPLE / total, seed=1)
    least = max(100, min(total, HOT_SAMPLE) // most)
    return [r[0] for r in sampled.groupBy(key).count().where(F.col("count") > least).orderBy(F.desc("count")).limit(most).select(key).collect()]


def hot_values(rows: DataFrame, key: str, most: int = HOT) -> DataFrame:
    """hot_list as a table."""
    return rows.sparkSession.createDataFrame([(v,) for v in hot_list(rows, key, most)], rows.select(key).schema)


def lookup(rows: DataFrame, facts: DataFrame, key: str, hot: list) -> DataFrame:
    """rows joined with facts, of which a key has one row. Rows of the hot keys (fewer than HOT) stay where they are, as
    their facts are broadcast; only the others are shuffled, so no task gets a third of all rows. The hot keys are told by a
    filter, not by a join; a null key has no facts."""
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    apart = rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key)
    return rows.where(~is_hot).join(facts, key).unionByName(apart)


def spread(rows: DataFrame, large: DataFrame, key: str, large_key: str, hot: DataFrame, by: str) -> DataFrame:
    """rows joined with large rows (texts), of which a key has one. What is large isn't broadcast: rows of a hot key are
    dealt by the column ``by`` over SALTS tasks, to each of which its large row goes."""
    named = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    dealt = rows.join(named, key, "left").withColumn("__salt", F.when(F.col("__hot"), salt_of(by)).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = large.withColumnRenamed(large_key, key).join(named, key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star rounds, each written to the shared folder, until the edges stay the same: every round is
    two grouped minima, combined in the map tasks, and joins on the node, in which the middle of a large star is no single task's.
    The number of rounds goes with the logarithm of the size of a component.
    """
    smaller = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = written(edges.select(*smaller).where("a <> b").select("a", "b").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        outward = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = lookup(outward, least, "a", hot_list(outward, "a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
