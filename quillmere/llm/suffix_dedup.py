"""Deduplication of byte strings by a common-prefix-aware distributed merge sort of suffixes.

Which suffixes are sorted: of all k-grams of a window of ``length`` bytes the one with the least hash is its anchor,
so equal windows have equal anchors at equal places, and only suffixes at anchors need sorting. Anchors whose hash
occurs once can't be in a repeated window and are left out.

The sort: a batch of documents is one run. Its suffixes (``length`` bytes from the anchor on, then the bytes before
it, nearest first) are sorted and front-coded: the length of the prefix shared with the suffix before, and the rest.
Equal suffixes are combined in the run: the first place stays, the others are covered. Runs are exchanged by the
anchor's k-gram, and combined with loser trees that keep for each suffix the prefix it shares with the last winner:
unequal shared prefixes decide a match without a look at the bytes, equal ones are compared from there on only.

In the merged order equal suffixes are neighbours, so again the first place stays and the others are covered; and
suffixes that share the k-gram are neighbours, in whose windows of ``length`` bytes repeats are looked up.

A k-gram that very many suffixes share would be one task's. Its suffixes, once equal ones are combined in a run, are
not exchanged; instead each of their windows is told by a digest, and the first place of each digest stays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm import common
from quillmere.llm.shingles import least_of_windows, mixed, powers

LENGTH, K = 100, 32
#: Never a byte of UTF-8: stands beyond a text's ends.
BEYOND = 0xFF
#: Suffixes that a task merges on average, and runs that one loser tree combines.
SHARE, FAN = 150_000, 64
#: Suffixes of one k-gram that are compared in one task at most; those of others are dealt by their windows.
GROUP = 5_000
#: Documents and bytes of a run at most; a longer document is a run of its own.
RUN_DOCS, RUN_BYTES = 10_000, 32 << 20

BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64))


_POWERS: list[np.ndarray] = [powers(BASE, 1 << 14), powers(INVERSE, 1 << 14)]


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """Of every K bytes in a row: sums of numbers times powers, moved back to the power zero."""
    n = len(data)
    if n > len(_POWERS[0]):
        _POWERS[:] = [powers(BASE, 2 * n), powers(INVERSE, 2 * n)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_NUMBERS[data] * _POWERS[0][:n], out=sums[1:])
    return mixed((sums[K:] - sums[:-K]) * _POWERS[1][: n - K + 1])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the least of some window; all of equal ones."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = kgram_hashes(data)
    at = least_of_windows(h, LENGTH - K + 1)
    return at, h[at]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


#: Instead of a place: the row only tells that its batch has the hash.
TELLS = -1


def anchor_rows(rows: DataFrame) -> DataFrame:
    """key, dealt, gram (the hash), pos of rows (key, text).

    A hash that a batch has once is dealt by itself. One that a batch has more often is known to repeat: its places are
    dealt by their document, written as -2 - pos, and a single row tells of the hash. So a hash that a third of all rows have is
    dealt as one row a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, rows=RUN_DOCS, text=1, most_bytes=RUN_BYTES):
            counts, places, hashes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                at, h = anchors(as_bytes(text))
                counts.append(len(at))
                places.append(at)
                hashes.append(h)
            h, pos = np.concatenate(hashes), np.concatenate(places)
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            known = np.zeros(len(h), bool)
            known[order[1:]] = same
            tells = order[1:][same & ~np.append(False, same)[: len(same)]] if len(same) else order[:0]
            known[order[:-1]] |= same
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)[row]
            dealt = np.where(known, mixed(keys), h)
            take = pa.array(np.append(row, row[tells]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(np.append(dealt, h[tells]).view(np.int64)), pa.array(np.append(h, h[tells]).view(np.int64)), pa.array(np.append(np.where(known, -2 - pos, pos), np.full(len(tells), TELLS)).astype(np.int32))],
                names=["key", "dealt", "gram", "pos"],
            )

    return rows.mapInArrow(run, "key long, dealt long, gram long, pos int")


def repeated(sorted_anchors: DataFrame) -> DataFrame:
    """key, gram, pos of the anchors that are known to repeat or whose neighbour has their hash; equal hashes are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of its own hash, and whether it is known to repeat

        def made(key: np.ndarray, gram: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            real = pos != TELLS
            return pa.RecordBatch.from_arrays([pa.array(key[real], pa.int64()), pa.array(gram[real], pa.int64()), pa.array(pos[real].astype(np.int32), pa.int32())], names=["key", "gram", "pos"])

        for batch in batches:
            key, _, h, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = pos < TELLS
            yield made(key[known], h[known], -2 - pos[known])
            key, h, pos = key[~known], h[~known], pos[~known]
            if not len(h):
                continue
            before = np.zeros(len(h), bool)
            before[1:] = h[1:] == h[:-1]
            if held is not None:
                before[0] = held[1] == h[0]
                if held[3] or before[0]:
                    yield made(*(np.array([v]) for v in held[:3]))
            keep = before.copy()
            keep[:-1] |= before[1:]
            held, keep[-1] = (int(key[-1]), int(h[-1]), int(pos[-1]), bool(before[-1])), False
            yield made(key[keep], h[keep], pos[keep])
        if held is not None and held[3]:
            yield made(*(np.array([v]) for v in held[:3]))

    return sorted_anchors.mapInArrow(run, "key long, gram long, pos int")


BEFORE = LENGTH - K
WIDTH = LENGTH + BEFORE
PLACES = np.concatenate([np.arange(LENGTH), -1 - np.arange(BEFORE)])


def suffixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of WIDTH bytes for each place."""
    framed = np.full(len(data) + BEFORE + LENGTH, BEYOND, np.uint8)
    framed[BEFORE : BEFORE + len(data)] = data
    return framed[(at + BEFORE)[:, None] + PLACES]


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, touching ones joined, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)]


RUN_ROWS = "part int, shared binary, rest binary, keys binary, pos binary, key long, starts array<int>, ends array<int>"
RUN_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
#: Bytes of the digest of a window.
DIGEST = 16
RUN_NAMES = [c.split()[0] for c in RUN_ROWS.split(", ")]


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix of each sorted row with the one before (0 of the first), and all rests."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)
    return shared, rows[np.arange(WIDTH) >= shared[:, None]].tobytes()


#: Suffixes whose k-grams are hashed at once.
HASHED = 2048


def led_windows(rows: np.ndarray, pos: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows whose first least k-gram is the anchor, for rows of suffixes() at the places pos of
    texts of these sizes. All other windows around an anchor have another one, and are looked up there."""
    first, last = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for i in range(0, len(rows), HASHED):
        some, at, size = rows[i : i + HASHED], pos[i : i + HASHED], sizes[i : i + HASHED]
        around = np.concatenate([some[:, LENGTH:][:, ::-1], some[:, :LENGTH]], axis=1)
        sums = np.zeros((len(some), WIDTH + 1), np.uint64)
        np.cumsum(BYTE_NUMBERS[around] * _POWERS[0][:WIDTH], axis=1, out=sums[:, 1:])
        h = mixed((sums[:, K:] - sums[:, :-K]) * _POWERS[1][: WIDTH - K + 1])
        place = at[:, None] - BEFORE + np.arange(h.shape[1])
        inside, least = (place >= 0) & (place + K <= size[:, None]), h[:, BEFORE, None]
        before, after = inside & (h <= least), inside & (h < least)
        before[:, BEFORE:], after[:, : BEFORE + 1] = False, False
        lower = np.where(before.any(axis=1), h.shape[1] - before[:, ::-1].argmax(axis=1), 0)  # behind the last one before
        upper = np.where(after.any(axis=1), after.argmax(axis=1), h.shape[1])
        first[i : i + HASHED] = np.maximum(at - BEFORE + lower, 0)
        last[i : i + HASHED] = np.minimum(at - 2 * BEFORE + upper - 1, size - LENGTH)
    return first, last


def window_digests(row: bytes, key: int, pos: int, first: int, last: int) -> Iterator[tuple[bytes, int, int]]:
    """Digest, key and start of the windows of the text that start from first to last, around the anchor of a suffix, which is a
    row of suffixes()."""
    around = row[LENGTH : LENGTH + pos - first][::-1] + row[: last + LENGTH - pos] if first <= pos else b""
    for start in range(first, last + 1):
        yield hashlib.blake2b(around[start - first : start - first + LENGTH], digest_size=DIGEST).digest(), key, start


class Run(NamedTuple):
    """Sorted suffixes of a batch, equal ones once, and keys, starts and ends of what the others cover."""

    rows: np.ndarray
    keys: np.ndarray
    pos: np.ndarray
    sizes: np.ndarray
    spans: np.ndarray


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Of batches (key, text, at)."""
    for batch in common.sliced(batches, rows=RUN_DOCS, text=1, most_bytes=RUN_BYTES):
        made, keys, pos, sizes = [np.zeros((0, WIDTH), np.uint8)], [], [], []
        for key, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, at = as_bytes(text), np.array(at, np.int64)
            made.append(suffixes(data, at))
            keys.append(np.full(len(at), key, np.int64))
            pos.append(at)
            sizes.append(np.full(len(at), len(data), np.int64))
        rows = np.ascontiguousarray(np.concatenate(made))
        if not len(rows):
            continue
        keys, pos, sizes = (np.concatenate(c) for c in (keys, pos, sizes))
        strings = rows.view(f"S{WIDTH}").ravel()
        order = np.lexsort((pos, keys))
        order = order[np.argsort(strings[order], kind="stable")]
        rows, keys, pos, sizes = (c[order] for c in (rows, keys, pos, sizes))
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        again = ~new
        starts, ends = np.maximum(pos - BEFORE, 0)[again], np.minimum(pos + LENGTH, sizes)[again]
        full = ends - starts >= LENGTH
        yield Run(rows[new], keys[new], pos[new], sizes[new], np.stack([keys[again][full], starts[full], ends[full]], axis=1))


def spans_by_key(spans: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """key, starts, ends of the union of the spans of each key."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    for group in np.split(spans, np.flatnonzero(np.diff(spans[:, 0])) + 1):
        if len(group):
            yield int(group[0, 0]), *joined_spans(group[:, 1], group[:, 2])


def sorted_runs(rows_: DataFrame, parts: int) -> DataFrame:
    """Of rows (key, text, at), by batch: covered spans by key, and runs by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys, pos, _, spans in runs_of(batches):
            out: list[tuple] = [(key % parts, None, None, None, None, key, s.tolist(), e.tolist()) for key, s, e in spans_by_key(spans)]
            part = np.array([zlib.crc32(r) for r in np.ascontiguousarray(rows[:, :K])], np.int64) % parts
            for p in np.unique(part).tolist():
                mine = part == p
                shared, rest = front_coded(rows[mine])
                out.append((p, shared.tobytes(), rest, keys[mine].tobytes(), pos[mine].astype(np.int32).tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * len(RUN_KINDS), RUN_KINDS, strict=True)], names=RUN_NAMES)

    return rows_.mapInArrow(run, RUN_ROWS)


def hot_windows(rows_: DataFrame) -> DataFrame:
    """digest, key, start, end of the first window of each digest in a batch, for rows (key, text, at) whose places have hot k-grams;
    without a digest what is known to be covered."""

    def hot_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys, pos, sizes, spans in runs_of(batches):
            first: dict[bytes, tuple[int, int]] = {}
            later: list[tuple[int, int]] = []
            begin, end = led_windows(rows, pos, sizes)
            for i in np.flatnonzero(begin <= end).tolist():
                for digest, key, start in window_digests(rows[i].tobytes(), int(keys[i]), int(pos[i]), int(begin[i]), int(end[i])):
                    known = first.get(digest)
                    if known is None or (key, start) < known:
                        first[digest] = key, start
                    if known is not None and known != (key, start):  # a window may have several anchors
                        later.append(max(known, (key, start)))
            if later:
                at = np.array(later, np.int64)
                spans = np.concatenate([spans, np.column_stack([at, at[:, 1] + LENGTH])])
            out: list[tuple] = [(digest, key, start, start + LENGTH) for digest, (key, start) in first.items()]
            for key, s, e in spans_by_key(spans):
                out += [(None, key, *span) for span in zip(s.tolist(), e.tolist(), strict=True)]
            kinds = pa.binary(), pa.int64(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], names=["digest", "key", "start", "end"])

    return rows_.mapInArrow(hot_run, "digest binary, key long, start int, end int")


class Suffix(NamedTuple):
    shared: int  # with the one before in the same run
    string: bytes
    key: int
    pos: int


def decoded(shared: bytes, rest: bytes, keys: bytes, pos: bytes) -> Iterator[Suffix]:
    last, at = b"", 0
    for n, key, place in zip(shared, np.frombuffer(keys, np.int64).tolist(), np.frombuffer(pos, np.int32).tolist(), strict=True):
        last = last[:n] + rest[at : at + WIDTH - n]
        at += WIDTH - n
        yield Suffix(n, last, key, place)


def merged(runs: list[Iterator[Suffix]]) -> Iterator[Suffix]:
    """One sorted run of at most FAN runs at a time, by a loser tree over the prefixes shared with the last winner."""
    while len(runs) > FAN:
        runs = [merged(runs[i : i + FAN]) for i in range(0, len(runs), FAN)]
    n = len(runs)
    heads = [next(r, None) for r in runs]
    #: Prefix that the head of each run shares with the last winner above it.
    known = [0] * n

    def beats(i: int, j: int) -> bool:
        """Whether the head of run i comes first; the loser then knows what it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]  # more of the last winner: smaller; what the loser shares with it stays
        at = known[i]
        differs = int.from_bytes(a.string[at:]) ^ int.from_bytes(b.string[at:])  # what is known to be shared isn't looked at
        if not differs:
            known[max(i, j)] = WIDTH
            return i < j
        shared = WIDTH - (differs.bit_length() + 7) // 8
        first = a.string[shared] < b.string[shared]
        known[j if first else i] = shared
        return first

    losers = [-1] * n  # at inner nodes 1..n-1; leaves are n..2n-1
    winners = [0] * (2 * n)
    for node in range(2 * n - 1, 0, -1):
        if node >= n:
            winners[node] = node - n
        else:
            i, j = winners[2 * node], winners[2 * node + 1]
            winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    top = winners[1] if n > 1 else 0
    while n and heads[top] is not None:
        head = heads[top]
        yield Suffix(known[top], head.string, head.key, head.pos)
        heads[top] = nxt = next(runs[top], None)
        known[top] = nxt.shared if nxt is not None else 0
        node, now = (top + n) // 2, top
        while node:
            other = losers[node]
            if not beats(now, other):
                losers[node], now = now, other
            node //= 2
        top = now


def ends(s: Suffix) -> tuple[int, int]:
    """Bytes before the anchor and from it on that are of the text."""
    right, left = s.string.find(BEYOND, 0, LENGTH), s.string.find(BEYOND, LENGTH)
    return BEFORE if left < 0 else left - LENGTH, LENGTH if right < 0 else right


def repeats_in(group: list[Suffix]) -> Iterator[tuple[int, int, int]]:
    """key, start, end of windows that an earlier one of the group equals; the suffixes differ, and share a k-gram.

    Equal windows have their anchors at equal places, so windows are compared with those as far before their anchor.
    """
    group = sorted(group, key=lambda s: (s.key, s.pos))
    frames = []
    for s in group:
        left, right = ends(s)
        frames.append((left, right, s.string[LENGTH : LENGTH + left][::-1] + s.string[:right]))
    for back in range(BEFORE + 1):
        seen: set[bytes] = set()
        for s, (left, right, around) in zip(group, frames, strict=True):
            if back <= left and LENGTH - back <= right:
                window = around[left - back : left - back + LENGTH]
                if window in seen:
                    yield s.key, s.pos - back, s.pos - back + LENGTH
                else:
                    seen.add(window)


def whole_span(s: Suffix) -> tuple[int, int, int] | None:
    left, right = ends(s)
    return (s.key, s.pos - left, s.pos + right) if left + right >= LENGTH else None


def covered(suffixes_: Iterator[Suffix]) -> Iterator[tuple[int, int, int]]:
    """Spans of a merged run: all but the first place of equal suffixes, and repeats among those of one k-gram."""
    group: list[Suffix] = []
    for s in suffixes_:
        if group and s.shared >= WIDTH:
            first = group[-1]
            later = s if (first.key, first.pos) < (s.key, s.pos) else first
            group[-1] = first if later is s else s
            if span := whole_span(later):
                yield span
            continue
        if group and s.shared < K:
            if len(group) > 1:
                yield from repeats_in(group)
            group = []
        group.append(s)
    if len(group) > 1:
        yield from repeats_in(group)


def merged_spans(runs: DataFrame) -> DataFrame:
    """key, start, end from the rows of sorted_runs, a part's rows in one partition and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, known = None, [], []

        def worked() -> pa.RecordBatch:
            found = (n for span in covered(merged([decoded(*p) for p in pieces])) for n in span)
            spans = np.concatenate([np.fromiter(found, np.int64).reshape(-1, 3), *known])
            pieces.clear()
            known.clear()
            spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
            new = np.ones(len(spans), bool)  # overlapping spans of a key are one
            new[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > spans[:-1, 2])
            first = np.flatnonzero(new)
            last = np.maximum.reduceat(spans[:, 2], first) if len(first) else spans[:, 2]
            return pa.RecordBatch.from_arrays([pa.array(spans[first, 0]), pa.array(spans[first, 1].astype(np.int32)), pa.array(last.astype(np.int32))], names=["key", "start", "end"])

        for batch in batches:
            for p, shared, rest, keys, pos, key, starts, ends_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is not None and p != part:
                    yield worked()
                part = p
                if shared is not None:
                    pieces.append((shared, rest, keys, pos))
                else:
                    known.append(np.stack([np.full(len(starts), key), starts, ends_], axis=1))
        yield worked()

    return runs.mapInArrow(run, "key long, start int, end int")


def later_windows(windows: DataFrame) -> DataFrame:
    """key, start, end of the windows (digest, key, start; each at most once a run) that aren't the first of their digest."""
    ordered = Window.partitionBy("digest").orderBy("key", "start")  # a digest has a row a run at most, and each is read once
    later = windows.withColumn("rank", F.rank().over(ordered)).where("rank > 1")
    return later.select("key", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def located(rows: DataFrame, places: DataFrame) -> DataFrame:
    """key, text, at of the rows (key, text) that have places (key, pos) in a written table; no other texts are moved."""
    near = common.Filter(places, "key").split(rows, "key")[0]
    return near.join(places.groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("at")), "key").select("key", "text", "at")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a row with a smaller doc_id, or
    earlier in the same row; matches end with their document. Null texts are empty, texts under LENGTH bytes are never
    touched. Where doc_ids repeat or are null, rows are ordered by doc_id, nulls last, and a hash of the text. An empty
    table gives no rows; other columns aren't read. A task merges about SHARE suffixes; equal ones are combined in
    every run before, so a string that a third of all rows share comes as one suffix a run, and a k-gram that stands in
    ever other surroundings, more than GROUP times at most, is dealt by its windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1")
    if counted.isEmpty():
        rows = rows.withColumn("key", F.col("id"))
    else:
        rows = common.written(rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text")).withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = anchor_rows(rows.select("key", "text")).repartition("dealt").sortWithinPartitions("dealt")
    places = common.written(repeated(found), "anchors")
    parts = max(1, round(places.count() / SHARE))
    # counts are exact, so no k-gram above the limit is merged in one task, however large the table is
    limit = min(GROUP, max(100, places.count() // common.HOT))
    few = common.written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("gram"), "hot-grams")
    n_hot = few.count()
    if n_hot <= common.HOT:
        is_hot = F.col("gram").isin([r["gram"] for r in few.collect()]) if n_hot else F.lit(False)
        hot, others = places.where(is_hot), places.where(~is_hot)
    else:
        hot, others = (common.written(places.join(common.small_or_shuffled(few), "gram", how), "parted-anchors") for how in ("left_semi", "left_anti"))
    exchanged = sorted_runs(located(rows, others), parts).repartition(parts, "part").sortWithinPartitions("part")
    spans = merged_spans(exchanged)
    if n_hot:
        # dealt by key: documents with hot anchors may lie in a few files, whose tasks would tell most of the windows
        windows = common.written(hot_windows(located(rows, common.written(hot, "hot-anchors")).repartition("key")), "hot-windows")
        later, within = later_windows(windows.where("digest is not null")), windows.where("digest is null").select("key", "start", "end")
        spans = spans.unionByName(later).unionByName(within)
    spans = common.written(spans, "spans")
    listed = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    hit, clean = common.Filter(spans, "key").split(rows, "key")
    nothing = [F.lit(None).cast("array<int>").alias(c) for c in ("starts", "ends")]
    joined = hit.join(listed, "key", "left").select("id", "text", "starts", "ends").unionByName(clean.select("id", "text", *nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            out: list[tuple] = []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = as_bytes(text)
                s, e = joined_spans(np.array(starts or [], np.int64), np.array(ends or [], np.int64))
                kept = b"".join([data[a:b].tobytes() for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)])
                out.append((len(data), len(data) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def oracle_sql() -> str:
    """suffix_dedup of the documents table in SQL: every string of LENGTH bytes is grouped (of distinct doc_ids)."""
    return f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM d),
w AS (SELECT b.doc_id, i, CASE WHEN i + {LENGTH - 1} <= n THEN substr(h, 2 * i - 1, {2 * LENGTH}) END AS w, substr(h, 2 * i - 1, 2) AS x FROM b JOIN d USING (doc_id)),
f AS (SELECT doc_id, i, x, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, x, sum(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS {LENGTH - 1} PRECEDING) > 0 AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
