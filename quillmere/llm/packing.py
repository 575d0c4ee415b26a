"""Packing of token pieces into sequences: best fit, then a swap-based local search that empties bins.

Pieces are dealt evenly, by a hash, into groups of a bounded number of pieces; each group is packed by itself, so the
number of sequences is above the best possible by a part of a bin a group at most from the dealing. Within a group
best-fit-decreasing gives the first packing. Then, from the emptiest bin on, a document of that bin is moved to
another underfull bin, or exchanged for a shorter one there, or two documents for one, or one for two, such that the
fuller bin gets fuller: the sum of squared fills rises with every step, so the search ends, and the emptiest bins
run empty. It ends when no bin has such a step, or as few bins are left as the lengths fill. Of documents of one length
in a bin one stands for all; so a bin has a bounded number of them and of their pairs, and all are tried.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm import common
from quillmere.llm.bpe import default_path, vocabulary

#: Pieces that one task packs together, on average.
GROUP = 20_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of positions in lengths; every length is at most capacity."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (what is left, bin), in order
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect.bisect_left(room, (n, -1))
        left, b = room.pop(k) if k < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > n:
            bisect.insort(room, (left - n, b))
    return bins


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The local search; returns the bins that are left."""
    n = len(lengths)
    where = np.empty(n, np.int64)
    fill = np.zeros(len(bins), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
        fill[b] = lengths[items].sum()
    least = -(-int(lengths.sum()) // capacity)
    alive = len(bins)
    done = np.zeros(len(bins), bool)  # bins without a step; a step of another bin can't give them one but through the bins it changes

    def put(item: int, b: int) -> None:
        fill[where[item]] -= lengths[item]
        fill[b] += lengths[item]
        where[item] = b

    while alive > least:
        candidates = np.flatnonzero(~done & (fill > 0) & (fill < capacity))
        if not len(candidates):
            break
        donor, moved = int(candidates[np.argmin(fill[candidates])]), False
        while fill[donor] and (step := _exchange(donor, where, fill, lengths, capacity)):
            (target, give, take), moved = step, True
            for i in give:
                put(i, target)
            for i in take:
                put(i, donor)
        if moved:  # what was given up may fit now
            done[:] = False
        done[donor] = True
        alive -= not fill[donor]
    order = np.argsort(where, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)] if n else []


def _pairs(bin_: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within a bin of entries in the order of bins; an entry with ``twice`` is a pair with itself too."""
    left, right = [np.flatnonzero(twice)], [np.flatnonzero(twice)]
    step = 1
    while len(near := np.flatnonzero(bin_[step:] == bin_[:-step])):
        left.append(near)
        right.append(near + step)
        step += 1
        if step >= len(bin_):
            break
    return np.concatenate(left), np.concatenate(right)


def _exchange(donor: int, where: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, list[int], list[int]] | None:
    """(bin, what it gets, what it gives back) of the largest gain of a bin that is at least as full as the donor."""
    room = capacity - fill
    room[(fill < fill[donor]) | (fill == 0)] = 0
    room[donor] = 0
    widest = int(room.max(initial=0))
    if not widest:
        return None
    mine = np.flatnonzero(where == donor)
    own, at, count = np.unique(lengths[mine], return_index=True, return_counts=True)
    i, j = _pairs(np.zeros(len(own), np.int64), count > 1)
    second = lambda k: int(mine[np.flatnonzero(lengths[mine] == own[k])[1]])
    sums = [(int(own[k]), [int(mine[at[k]])]) for k in range(len(own))]
    sums += [(int(own[a] + own[b]), [int(mine[at[a]]), second(b) if a == b else int(mine[at[b]])]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    best, found = 0, None
    open_items = np.flatnonzero(room[where] > 0)
    keys, first, counts = np.unique(where[open_items] * (capacity + 1) + lengths[open_items], return_index=True, return_counts=True)
    items, their, bins = open_items[first], keys % (capacity + 1), keys // (capacity + 1)
    space = room[bins]
    for total, give in sums:
        if total > best and total <= widest:  # a move
            fits = np.flatnonzero(room >= total)
            best, found = total, (int(fits[np.argmin(room[fits])]), give, [])
        gain = total - their
        gain[(gain > space) | (gain <= best)] = 0
        if len(gain) and gain[k := int(np.argmax(gain))] > best:
            best, found = int(gain[k]), (int(bins[k]), give, [int(items[k])])
    if found is None and len(items):  # one for two of another bin
        i, j = _pairs(bins, counts > 1)
        pair, space = their[i] + their[j], space[i]
        for total, give in sums[: len(own)]:
            gain = total - pair
            gain[(gain > space) | (gain <= best)] = 0
            if len(gain) and gain[k := int(np.argmax(gain))] > best:
                a, b = int(i[k]), int(j[k])
                same = open_items[(where[open_items] == bins[a]) & (lengths[open_items] == their[b])]
                best, found = int(gain[k]), (int(bins[a]), give, [int(items[a]), int(same[1] if a == b else items[b])])
    return found


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(empty_bins(best_fit_decreasing(lengths, capacity), lengths, capacity)):
        bins[items] = b
        offsets[items] = np.concatenate([[0], np.cumsum(lengths[items])[:-1]])
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int = 4096, eos: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and eos, cut only beyond the capacity."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, end = vocabulary(path), eos.to_bytes(4, "little")
        for batch in common.sliced(batches, text=1):
            rows, out = [], ([], [], [], [])
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = v.encode(text or "") + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append(at)
                    for column, value in zip(out, (piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit_pack(docs: DataFrame, capacity: int = 4096, eos: int = 1, path: str | None = None, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    A null or empty text is one piece of the end token alone. Rows that repeat a doc_id are packed each for itself.
    An empty table gives no rows. Other columns aren't read. Only lengths are dealt out, by the number of the row: a task
    holds about ``group`` rows of numbers, whatever the texts' lengths and however often rows repeat.
    """
    pieces = common.written(token_pieces(docs, capacity, eos, path, id_col, text_col), "pieces")
    full = pieces.where(F.col("length") == capacity)
    open_ = pieces.where(F.col("length") < capacity)
    groups = max(1, round(open_.count() / group))
    dealt = open_.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("group").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack(rows.column("length").to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    packed = dealt.groupBy("group").applyInArrow(pack_group, schema)
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
