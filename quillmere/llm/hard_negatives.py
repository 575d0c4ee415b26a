"""Hard negatives by blocked matrix products.

Anchors are cut into blocks of a bounded size. Each block is broadcast and multiplied with all rows, which are read in blocks
where they lie; nothing else is moved. A first pass keeps each anchor's best rows of its own label, as partial lists that
are merged by a window; a second one keeps, for each of these positives, the best rows of other labels whose score lies in
the positive's window. Products are float64 and exact, as a bound on their sums is tested to be below 2^53; a block that breaks it is
multiplied in whole numbers, and a score beyond 64 bits is held at the end of their range.

Rows: a null label, id or vector, or a null or non-finite component, takes a row out. Vectors meet only vectors of
their own length. Rows repeated in full count once, others that share an id
count each; but a row with an anchor's own id is neither its positive nor its negative. Ties go by the smaller id. Only the three columns are read, so extra ones don't matter.
Without anchors, or in an empty table, there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm import common

#: Positives of an anchor, and negatives of a positive.
BEST = 5
#: Bytes of the vectors of a block of anchors, in float64: what a broadcast holds at most, but for one vector of any length.
BLOCK_BYTES = 32 << 20
#: Rows of a block of candidates, and products that are held at once.
ROWS, PRODUCTS = 4096, 1 << 22
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = 1 << 53
PARTIAL = "anchor long, slot int, score long, id long, row long"


def usable(vector: str, label: str, key: str) -> Column:
    """Rows that take part."""
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


class Group(NamedTuple):
    """Rows of one length and label, ascending by id: a row of whole numbers for each."""

    ids: np.ndarray
    rows: np.ndarray  # digests of the whole rows, or the numbers of anchors
    vectors: np.ndarray


def grouped(ids: np.ndarray, labels: np.ndarray, lists: pa.Array, rows: np.ndarray, scale: int) -> dict[tuple[int, int], Group]:
    """By (length, label); rows that are alike are one."""
    _, once = np.unique(np.stack([ids, rows]), axis=1, return_index=True)  # ascending by id
    offsets = np.asarray(lists.offsets)
    lengths, flat = np.diff(offsets), np.asarray(lists.values)
    made = {}
    for length, label in {*zip(lengths.tolist(), labels.tolist(), strict=True)}:
        at = once[(lengths[once] == length) & (labels[once] == label)]
        made[length, label] = Group(ids[at], rows[at], quantised(flat[offsets[at][:, None] + np.arange(length)], scale))
    return made


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, whole and exact."""
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if most < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in anchors], object), np.array([[int(x) for x in row] for row in rows], object)
    exact = [[min(HIGH, max(LOW, sum(x * y for x, y in zip(a, b, strict=True)))) for b in whole[1]] for a in whole[0]]
    return np.array(exact, np.int64).reshape(len(anchors), len(rows))


def best_within(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor's row, column) of each anchor's best scores from low to high; columns ascend in ids, whose order breaks
    ties, and columns with the anchor's own id are left out."""
    able = (scores >= low[:, None]) & (scores <= high[:, None]) & (ids[None, :] != own[:, None])
    if np.count_nonzero(able) > 4 * best * len(scores) and scores.shape[1] > best:
        least = np.partition(np.where(able, scores, LOW), -best, axis=1)[:, -best]
        able &= scores >= least[:, None]
    i, j = np.nonzero(able)
    order = np.lexsort((j, ~scores[i, j], i))
    i, j = i[order], j[order]
    kept = _ranks(i) < best
    return i[kept], j[kept]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Places, from 0, within runs of equal keys."""
    n = len(keys[0])
    starts = np.zeros(n, bool)
    for k in keys:
        starts[1:] |= k[1:] != k[:-1]
    return np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))


class Task:
    """What one task has found: at most ``best`` rows for each anchor and slot after a merge, and the least score that still counts."""

    def __init__(self, best: int, low: np.ndarray, base: int) -> None:
        self.best, self.low, self.base, self.found, self.held = best, low, base, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.found.append(np.stack(columns))
        self.held += len(columns[0])
        if self.held > 1 << 20:
            self.merge()

    def merge(self) -> np.ndarray:
        """Rows (anchor, slot, score, id, row), the best first."""
        rows = np.concatenate([np.zeros((5, 0), np.int64), *self.found], axis=1)
        rows = rows[:, np.lexsort((rows[4], rows[3], ~rows[2], rows[1], rows[0]))]  # ~ turns the order round and can't overflow
        rows = rows[:, _ranks(*rows) == 0]  # a row that was repeated in several blocks
        rank = _ranks(rows[0], rows[1])
        rows, rank = rows[:, rank < self.best], rank[rank < self.best]
        last = rows[:, rank == self.best - 1]
        self.low[last[1], last[0] - self.base] = last[2]
        self.found, self.held = [rows], -(len(rank) // 2)
        return rows


def _blocks(anchors: DataFrame) -> list[tuple[int, int]]:
    """Ranges of anchors' numbers whose vectors take BLOCK_BYTES at most."""
    total, longest = anchors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    step = max(1, BLOCK_BYTES // (8 * max(1, longest or 1)))
    return [(at, min(at + step, total)) for at in range(0, total, step)]


def _numbered(anchors: DataFrame) -> DataFrame:
    """A written table with ascending numbers n from 0 by prefix sums over ranges of the id."""
    ranged = common.written(anchors.distinct().repartitionByRange("id", "label", F.xxhash64("v")).withColumn("part", F.spark_partition_id()), "anchors")
    counts = ranged.groupBy("part").count()
    starts = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("id", "label", "v"))
    # one row a partition
    return common.written(ranged.withColumn("row", within).join(F.broadcast(starts), "part").select((F.col("before") + F.col("row") - 1).alias("n"), "id", "label", "v"), "anchors")


def _pass(rows: DataFrame, block: pa.Table, bounds: np.ndarray | None, best: int, scale: int, same: bool) -> DataFrame:
    """Partial lists of the rows' tasks for a block of anchors (n, id, label, v). bounds: n, slot, low and high of each positive."""
    shared = rows.sparkSession.sparkContext.broadcast((block, bounds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits = shared.value
        lists = pa.concat_arrays(anchors["v"].chunks)
        of = grouped(anchors["id"].to_numpy(), anchors["label"].to_numpy(), lists, anchors["n"].to_numpy(), scale)
        base, slots = anchors["n"][0].as_py(), 1 if limits is None else best
        low, high = (np.full((slots, anchors.num_rows), LOW if (limits is None) is lowest else HIGH) for lowest in (True, False))
        if limits is not None:
            low[limits[1], limits[0] - base], high[limits[1], limits[0] - base] = limits[2], limits[3]
        task = Task(best, low, base)
        for batch in common.sliced(batches, ROWS):
            ids, labels, digests = (np.asarray(batch.column(c)) for c in (0, 1, 3))
            for (length, label), there in grouped(ids, labels, batch.column(2), digests, scale).items():
                for (own_length, own_label), own in of.items():
                    if length == own_length and (label == own_label) is same:
                        step = max(1, PRODUCTS // len(there.ids))
                        for at in range(0, len(own.ids), step):
                            part = slice(at, at + step)
                            scores, n = products(own.vectors[part], there.vectors), own.rows[part]
                            for slot in range(slots):
                                i, j = best_within(scores, there.ids, own.ids[part], low[slot, n - base], high[slot, n - base], best)
                                task.add(n[i], np.full(len(i), slot), scores[i, j], there.ids[j], there.rows[j])
        made = task.merge()
        yield pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1].astype(np.int32)), *map(pa.array, made[2:])], names=["anchor", "slot", "score", "id", "row"])

    return rows.select("id", "label", "v", F.xxhash64("id", "label", "v").alias("row")).mapInArrow(find, PARTIAL)


def _merged(partial: DataFrame, best: int) -> DataFrame:
    """anchor, slot, id, score, rank: the best of all partial lists, in which a repeated row may be several times. Spark drops
    what can't be among the best before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    ranked = partial.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= best)
    return ranked.distinct().select("anchor", "slot", "id", "score", "rank")


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", best: int = BEST, share: tuple[int, int] = (4, 5), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of the ``best`` positives of a row that
    ``anchor`` holds for, the ``best`` rows of another label that score between ``share`` of the positive's score and the score
    itself. Components become floor(scale * x); a score is the inner product of these."""
    of = F.col(label) if isinstance(label, str) else label
    taken = rows.withColumn("__label", of.cast("long")).withColumn("__key", F.col(key).cast("long")).where(usable(vector, "__label", "__key"))
    clean = taken.select(F.col("__key").alias("id"), F.col("__label").alias("label"), F.col(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    anchors = _numbered(clean.where("is_anchor").select("id", "label", "v"))
    num, den = share
    results = []
    for start, stop in _blocks(anchors):
        block = anchors.where((F.col("n") >= start) & (F.col("n") < stop)).orderBy("n").toArrow()
        positives = common.written(_merged(_pass(clean, block, None, best, scale, same=True), best), "positives")
        found = positives.select("anchor", F.col("rank").alias("slot"), "score").toArrow()  # at most ``best`` rows an anchor of the block
        n, slot, score = (found[c].to_numpy().astype(np.int64) for c in found.column_names)
        # the least score that is num / den of the positive's, in whole numbers of any size
        low = np.array([max(LOW, -((-num * int(s)) // den)) for s in score], np.int64)
        negatives = _merged(_pass(clean, block, np.stack([n, slot - 1, low, score]), best, scale, same=False), best)
        ids = anchors.where((F.col("n") >= start) & (F.col("n") < stop)).select(F.col("n").alias("anchor"), F.col("id").alias("anchor_id"))
        named = positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
        results.append(common.written(negatives.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "slot"]), "negatives"))
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if not results:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.select(*columns)
