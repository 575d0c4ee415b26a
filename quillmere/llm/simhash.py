"""Near copies by SimHash: fingerprints of 64 bits, linked by vantage-point trees.

Points of a metric space are parted by their distance to a vantage point. A tree fitted on a bounded sample deals all
fingerprints into shards: what lies within the median distance goes inwards, the rest outwards, and of the rest what
lies within the radius of the boundary is a guest inside too. By the triangle inequality two fingerprints that are no
further apart than the radius then share a shard. A shard is searched by the same bound: its fingerprints are ordered by
their distances to two vantage points, and only rings that are no further apart than the radius are compared.

Texts: null and empty ones, and those without a word, have the fingerprint zero and are linked like any others. Rows
without an id, and repeated ids, each keep a row; a component whose rows have no id at all has no id either. Only the id
and the text are read, so extra columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common

#: Words of a shingle, seed of its hash, and bits by which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a piece ends at a space."""
    start = 0
    while start < len(text):
        end = SPACE.search(text, start + size)
        stop = end.start() if end else len(text)
        yield text[start:stop].split()  # splits at exactly the six characters of SPACE
        start = stop


def hashes(text: bytes, size: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text whose letters are lower-case, repeats included, some at a time."""
    hashed, tail, any_made = xxhash.xxh64_intdigest, [], False
    for words in pieces(text, size):
        words = tail + words
        if len(words) >= SHINGLE:
            any_made = True
            runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
            yield np.array([hashed(b" ".join(run), SEED) for run in runs], np.uint64)
        tail = words[-(SHINGLE - 1) :]
    if tail and not any_made:
        yield np.array([hashed(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: bytes, size: int = PIECE) -> int:
    """A bit is 1 if it is set in over half of the hashes; without a word all are 0."""
    ones, total = np.zeros(64, np.int64), 0
    for found in hashes(text.lower(), size):  # of bytes, so A-Z only
        for at in range(0, len(found), 1 << 14):
            part = found[at : at + (1 << 14)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(found)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed number) of every row."""
    schema = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("fp")).schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            found = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), common.text_of(text_col).cast("binary").alias("text")).mapInArrow(made, schema)


# ---- the tree ---------------------------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Inner nodes: vantage point, distance, and the nodes within and beyond it; a number below zero is shard -1 - n."""

    points: np.ndarray
    bounds: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shards: int


#: Fingerprints that the tree is fitted on at most (2 MB in the driver). They decide how rows are dealt and nothing else.
SAMPLE = 1 << 18
#: Sampled fingerprints that a shard has at least, so that its size is known to a third or so.
LEAST = 12
#: A node is a shard if its inner part, with guests, would be more than this share of it: its points lie so close
#: together (in some 30 bits or fewer) that a boundary parts nothing.
SHRINK = 0.92


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def fit_tree(sample: np.ndarray, most: int, radius: int = RADIUS) -> Tree:
    """A tree whose shards hold ``most`` of the sampled points or fewer, guests included, where they can be parted."""
    rng = np.random.default_rng(7)
    points, bounds, inner, outer, shards = [], [], [], [], 0
    stack: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]  # points, parent, side
    while stack:
        own, parent, side = stack.pop()
        split = None
        if len(own) > max(most, LEAST):
            for point in rng.choice(own, min(3, len(own)), replace=False):  # of a few, the one that has the fewest guests
                d = distance(own, point)
                bound = int(np.median(d))
                bound -= bool(np.all(d <= bound))
                within, guests = np.count_nonzero(d <= bound), np.count_nonzero((d > bound) & (d <= bound + radius))
                if bound >= 0 and within < len(own) and (split is None or guests < split[0]):
                    split = guests, point, bound, d, within
        if split is None or split[0] + split[4] > SHRINK * len(own):
            shards += 1
            at = -shards
        else:
            _, point, bound, d, _ = split
            at = len(points)
            points.append(point), bounds.append(bound), inner.append(0), outer.append(0)
            stack += [(own[d > bound], at, 1), (own[d <= bound + radius], at, 0)]
        if parent >= 0:
            (outer if side else inner)[parent] = at
    return Tree(np.array(points, np.uint64), np.array(bounds, np.int64), np.array(inner, np.int64), np.array(outer, np.int64), shards)


def dealt(tree: Tree, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """shard and fingerprint: each in the shard it lies in, and as a guest in those whose boundary is near."""
    if not len(tree.points):
        return np.zeros(len(fps), np.int64), fps
    shards, rows = [], []
    stack = [(0, fps)]
    while stack:
        at, own = stack.pop()
        if at < 0:
            shards.append(np.full(len(own), -1 - at, np.int64)), rows.append(own)
        elif len(own):
            d, bound = distance(own, tree.points[at]).astype(np.int64), tree.bounds[at]
            stack += [(int(tree.outer[at]), own[d > bound]), (int(tree.inner[at]), own[d <= bound + radius])]
    return np.concatenate(shards), np.concatenate(rows)


# ---- a shard ----------------------------------------------------------------------------------------------------------

#: Distances that are computed at once: 8 MB of differences.
BLOCK = 1 << 20


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of a component) after joining the places a with the places b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while not np.array_equal(nearer := label[label], label):
            label = nearer


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of some distinct fingerprints the place of one of its component, the same for all of it.

    Rings of equal distance to two vantage points are compared only with rings no further than the radius away. Rows
    that are of one component already aren't compared with others of it, so a crowd of near copies costs few comparisons.
    """
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    first = distance(fps, fps[0]).astype(np.int64)
    second = distance(fps, fps[int(np.argmin(np.abs(first - 32)))]).astype(np.int64)
    order = np.lexsort((second, first))
    cell = first[order] * 65 + second[order]
    points = fps[order]
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], n], strict=True):
        ring, inner = divmod(int(cell[start]), 65)
        for other in range(ring, min(64, ring + radius) + 1):
            low = start if other == ring else int(np.searchsorted(cell, other * 65 + max(0, inner - radius)))
            high = int(np.searchsorted(cell, other * 65 + min(64, inner + radius), side="right"))
            if low < high:
                label = _compared(points, label, start, stop, low, high, radius)
    back = np.empty(n, np.int64)
    back[order] = order[label]
    return back


def _compared(points: np.ndarray, label: np.ndarray, start: int, stop: int, low: int, high: int, radius: int) -> np.ndarray:
    """Labels after comparing the rows from start to stop with those from low to high."""
    step = max(1, min(256, BLOCK // (high - low)))
    for at in range(start, stop, step):
        rows = np.arange(at, min(at + step, stop))
        of = label[rows]
        values, counts = np.unique(of, return_counts=True)
        crowd = values[np.argmax(counts)]
        others = np.arange(low, high)
        for some, against in ((rows[of == crowd], others[label[low:high] != crowd]), (rows[of != crowd], others)):
            wide = max(1, BLOCK // max(1, len(some)))
            for c in range(0, len(against) if len(some) else 0, wide):
                part = against[c : c + wide]
                i, j = np.nonzero(distance(points[some][:, None], points[part][None, :]) <= radius)
                if len(i):
                    label = _unite(label, some[i], part[j])
    return label


# ---- on Spark ---------------------------------------------------------------------------------------------------------

#: Fingerprints of a shard at most, where they can be parted: half a megabyte, which a core's cache holds.
SHARD = 1 << 16


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: links that connect what is no further apart than the radius, of a written table of distinct fingerprints fp.
    A fingerprint has at most one link a shard, so near copies aren't expanded into pairs."""
    spark, total = distinct.sparkSession, distinct.count()
    sampled = distinct if total <= SAMPLE else distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int(SAMPLE / total * (1 << 30)))
    sample = np.sort(np.asarray(sampled.select("fp").toArrow()["fp"].to_numpy(), np.int64)).view(np.uint64)
    size = min(shard, max(1024, total // (4 * spark.sparkContext.defaultParallelism)))  # shards enough for all cores
    tree = fit_tree(sample, max(1, int(size * len(sample) / max(1, total))), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, rows = dealt(tree, np.asarray(batch.column(0).to_numpy(), np.int64).view(np.uint64), radius)
            for made in pa.table({"shard": shards, "fp": rows.view(np.int64)}).to_batches(max_chunksize=1 << 16):
                yield made

    def search(table: pa.Table) -> pa.Table:
        fps = np.sort(table["fp"].to_numpy().view(np.uint64))
        to = linked(fps, radius)
        own = np.flatnonzero(to != np.arange(len(fps)))
        return pa.table({"a": fps[to[own]].view(np.int64), "b": fps[own].view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(search, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The id, fingerprint (16 hexadecimal digits) and component_id of every row: the smallest id that is reached by links
    between fingerprints that differ in ``radius`` bits or fewer. Exact: the tree's sample decides only how rows are dealt."""
    rows = common.written(fingerprints(docs, id_col, text_col), "fingerprints")
    own = common.written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = common.written(common.components(common.written(links(own, radius, shard), "links")).select(F.col("node").alias("fp"), "root"), "roots")
    named = common.written(own.join(roots, "fp").select("fp", "root", "first"), "linked-fingerprints")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    linked_ = common.lookup(named.select("fp", "root"), least, "root", common.hot_list(named, "root")).select("fp", "component")
    alone = own.join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component"))
    facts = common.written(alone.unionByName(linked_), "components")
    found = common.lookup(rows, facts, "fp", common.hot_list(rows, "fp"))
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
