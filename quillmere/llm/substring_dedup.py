"""Substring deduplication by collinear chaining.

Seeds are word k-mers chosen by winnowing: of each ``window`` k-mers in a row the one with the least hash, so two
texts that share window + k - 1 words share a seed. The n-th occurrence of a k-mer in a text is a seed of its own, so
repetitive texts match in order. Each occurrence of a seed is matched with its first one (smallest document, then
place) and with the one before it: a star and a path, not all pairs, so a passage is also found if its seeds first occur here and
there. The matches of two documents are chained in the order of both texts: a chain scores for
each seed and pays for gaps in either text, and a Fenwick tree over the places in the first text gives every match the
best chain that it can go on. Chains are aligned word by word, between seeds by edit distance and beyond their ends as
far as words agree, and cut at gaps that don't align; what is long and similar enough is a passage that repeats, and
is removed from the later document.

Short seeds alone would still lose passages whose seeds occur here and there in between. So there are long seeds too, of
about half of min_words words, winnowed so that any min_words words in a row hold one. Wherever the same min_words words
occur, this seed occurs. Of a seed that occurs more than once, all windows of min_words words around its places are
matched with their own first occurrence, but those of which it is known that an earlier document has them word by word.
So every exact passage of min_words words is found, whatever its seeds are matched with.

What is left are seeds in words that aren't removed, whose partners are neither the first row nor the row before. A chain has
two of them, least_span words apart; so all pairs of such seeds of a text are joined with the same pairs of all earlier texts,
and their matches are chained and aligned too. No partner is left out, however many rows a seed has, and a seed that
very many rows have makes no rows by itself. Texts that are equal in full need no seeds: all but the first are removed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common
from quillmere.llm.shingles import ODD, least_of_windows, mixed, rolled, window_hashes, word_numbers

K, WINDOW = 5, 12
#: Price of a word of a gap, in either text; a seed earns K.
GAP = 0.1
#: A gap with more words that differ, and less than half that match, is a place to cut a chain at.
DROP = 12
#: Of the seeds of a stretch of equal words the share that a chain has where its alignment is sure to hold: no more is asked there.
DENSE = 0.6
#: Words between two seeds of a pair at most: four seeds in a row pay for a gap that is as long in both texts.
FAR = 100
#: A place is the number of a word, above what else is told of it: of a seed whether it is a long one.
AT = 32


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` in a row, all of equal ones; of fewer hashes, of all of them."""
    return least_of_windows(hashes, min(window, len(hashes))) if len(hashes) else np.zeros(0, np.int64)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with how often it came before mixed in."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    before = np.empty(len(hashes), np.uint64)
    before[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff([*starts, len(hashes)]))
    return np.where(before > 0, mixed(hashes + before * ODD), hashes)


def long_seed(min_words: int) -> int:
    """Words of a long seed."""
    return (min_words + K) // 2


def long_seeds(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the long seeds, of which any min_words words hold one."""
    size = long_seed(min_words)
    if len(words) < min_words:
        return words[:0], np.zeros(0, np.int64)
    h = window_hashes(words, size, np.arange(len(words) - size + 1))
    at = least_of_windows(h, min_words - size + 1)
    return h[at], at


def numbers(key: pa.Array, counts: list[int], seed: list[np.ndarray], place: list[np.ndarray]) -> pa.RecordBatch:
    take = pa.array(np.repeat(np.arange(len(counts)), counts))
    both = [np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in ((np.uint64, seed), (np.int64, place))]
    return pa.RecordBatch.from_arrays([key.take(take), pa.array(both[0].view(np.int64)), pa.array(both[1])], names=["key", "seed", "place"])


def seeds(rows: DataFrame, min_words: int) -> DataFrame:
    """key, seed, place of rows (key, text), and a row with the number of words, as -1 - n, for each text that has seeds;
    texts under K words have none. What occurs again in a text is there by its number and as it is, so each copy of an
    earlier document's passage meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            counts, found, places = [], [], []
            for text in batch.column(1).to_pylist():
                words = word_numbers(text)
                if len(words) < K:
                    counts.append(0)
                    continue
                h = rolled(words, K)
                at = winnowed(h, WINDOW)
                own, place = numbered(h[at]), at.astype(np.int64) << AT
                again = own != h[at]
                far, starts = long_seeds(words, min_words)
                parts = [own, h[at][again], far, np.zeros(1, np.uint64)]
                counts.append(sum(map(len, parts)))
                found += parts
                places += [place, place[again], (starts << AT) | 1, np.array([-1 - len(words)])]
            yield numbers(batch.column(0), counts, found, places)

    return rows.mapInArrow(run, "key long, seed long, place long")


MATCH = ["key", "place", "ref", "ref_place", "prev", "prev_place"]


def of_ordered(batches: Iterator[pa.RecordBatch], own: bool) -> Iterator[pa.RecordBatch]:
    """with_first of batches (seed, key, place) in this order. What is held from batch to batch is the first row of a seed,
    the row before and the last one, so a seed of any number of rows needs no room."""
    held = [np.zeros(0, np.int64)] * 3
    before = None  # seed, key and place of the row before those held, and key and place of the first row of its seed

    def rows(seed: np.ndarray, key: np.ndarray, place: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        nonlocal before
        if before is None:
            before = (~seed[0], 0, 0, 0, 0)
        own_seed = np.concatenate([[before[0]], seed])
        goes_on = own_seed[1:] == own_seed[:-1]
        start = np.maximum.accumulate(np.where(goes_on, -1, np.arange(len(seed))))
        ref, ref_place = np.where(start < 0, before[3], key[start]), np.where(start < 0, before[4], place[start])
        prev, prev_place = np.concatenate([[before[1]], key[:-1]]), np.concatenate([[before[2]], place[:-1]])
        other = goes_on & (prev != ref) & (prev != key)
        before = (seed[-1], key[-1], place[-1], ref[-1], ref_place[-1])
        kept = goes_on | (again & (place & 1 == 1) if own else False)
        columns = key, place, ref, ref_place, np.where(other, prev, key), np.where(other, prev_place, 0)
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=MATCH)

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        if len(held[0]) > 1:
            yield rows(*(h[:-1] for h in held), held[0][1:] == held[0][:-1])
            held = [h[-1:] for h in held]
    if len(held[0]):
        yield rows(*held, np.zeros(len(held[0]), bool))


def with_first(seeds_: DataFrame, own: bool = False) -> DataFrame:
    """key, place, ref, ref_place, prev, prev_place: the rows (key, seed, place) of a written table that aren't the first ones
    of their seed, each with the first one, and with ``own`` of seeds that occur again the first ones of odd places too. prev is the
    row of the seed before this one; where that is one of the first row's document, or of its own, prev is the row's own key.
    The first places of the seeds that very many rows have, which are fewer than common.HOT, are found within the map tasks
    and handed to them, without a row before; of all others by a sort."""
    schema = ", ".join(f"{c} long" for c in MATCH)
    few = common.hot_list(seeds_, "seed")
    rest = seeds_.where(~F.col("seed").isin(few)) if few else seeds_
    ordered = rest.select("seed", "key", "place").repartition("seed").sortWithinPartitions("seed", "key", "place")
    both = ordered.mapInArrow(lambda batches: of_ordered(batches, own), schema)
    if not few:
        return both
    hot = seeds_.where(F.col("seed").isin(few))
    firsts = sorted((r["seed"], r["first"]["key"], r["first"]["place"]) for r in hot.groupBy("seed").agg(F.min(F.struct("key", "place")).alias("first")).collect())
    known = [np.array(c, np.int64) for c in zip(*firsts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, seed, place = (c.to_numpy() for c in batch.columns)
            at = np.searchsorted(known[0], seed)
            ref, ref_place = known[1][at], known[2][at]
            kept = (ref != key) | (ref_place != place) | ((place & 1 == 1) if own else False)
            columns = key, place, ref, ref_place, key, np.zeros(len(key), np.int64)  # the other partners are found by pairs
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=MATCH)

    return both.unionByName(hot.select("key", "seed", "place").mapInArrow(run, schema))


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the rows that are equal in all columns, where equal ones are together."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of matches (x, y), x rising: lists of indices, the best ones first; each match is in one at most."""
    n = len(x)
    ranks = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    for i in range(n):
        cost, r = GAP * (x[i] + y[i]), ranks[y[i]]
        best, k = (-1e18, -1), r - 1
        while k > 0:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        gain = best[0] - cost
        score[i] = K + max(0.0, gain)
        if gain > 0:
            before[i] = best[1]
        entry, k = (score[i] + cost, i), r
        while k <= size:
            if entry > tree[k]:
                tree[k] = entry
            k += k & -k
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


#: A chain, or with a null ref first and last starts of the windows to match, or with the words -1 passages by start and end, or
#: with the words LEFT places of seeds that no passage covers so far, and the number of words.
FOUND = "key long, ref long, words int, xs array<int>, ys array<int>"
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
LEFT = -2


def handed(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches, cut between keys; rows of a key, which its text bounds, are together."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(p) for p in zip(rest, columns, strict=True)]
        before = np.flatnonzero(columns[0] != columns[0][-1]) if len(columns[0]) else []
        cut = int(before[-1]) + 1 if len(before) else 0  # the last key may go on in the next batch
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def dense(xs: list[int], ys: list[int], min_words: int) -> list[tuple[int, int]]:
    """Start and end of the stretches of a chain, in words of the later text, that are passages for sure: min_words words or
    more with seeds all along, as many as DENSE of those that equal texts have, in about as many words of the earlier text."""
    out, start = [], 0
    for i in range(1, len(xs) + 1):
        if i < len(xs) and max(xs[i] - xs[i - 1], ys[i] - ys[i - 1]) <= 2 * WINDOW:
            continue
        words, others = xs[i - 1] + K - xs[start], ys[i - 1] + K - ys[start]
        if words >= min_words and 10 * abs(words - others) <= words and (i - start) * (WINDOW + 1) >= 2 * DENSE * words:
            out.append((xs[start], xs[i - 1] + K))
        start = i
    return out


def paired(key: np.ndarray, ref: np.ndarray, x: np.ndarray, y: np.ndarray, least_span: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """key, ref, xs, ys of the chains of matches that span least_span words or more."""
    if not len(key):
        return
    order = np.lexsort((-y, x, ref, key))
    key, ref, x, y = (c[order] for c in (key, ref, x, y))
    start, end = grouped(key, ref)
    for g in np.flatnonzero((end - start > 1) & (x[end - 1] - x[start] + K >= least_span)).tolist():
        i, j = int(start[g]), int(end[g])
        xs, ys = x[i:j].tolist(), y[i:j].tolist()
        for chain in chains(xs, ys):
            if xs[chain[-1]] - xs[chain[0]] + K >= least_span:
                yield int(key[i]), int(ref[i]), [xs[c] for c in chain], [ys[c] for c in chain]


def found_in(key: np.ndarray, place: np.ndarray, ref: np.ndarray, ref_place: np.ndarray, prev: np.ndarray, prev_place: np.ndarray, min_words: int, least_span: int) -> list[tuple]:
    """Rows of FOUND. The columns are in the order of key; each key has a row with its number of words, as -1 - n.

    Matches with the row before go into chains only where no stretch that agrees, or that a chain with first rows is
    dense in, covers them: what is removed already needs no second witness.
    """
    size = long_seed(min_words)
    told = place < 0
    order = np.argsort(key[told], kind="stable")
    keys, sizes = key[told][order], -1 - place[told][order]
    key, place, ref, ref_place, prev, prev_place = (c[~told] for c in (key, place, ref, ref_place, prev, prev_place))
    if not len(key):
        return []
    x, y, is_long = place >> AT, ref_place >> AT, (place & 1).astype(bool)
    out: list[tuple] = []
    whole: dict[tuple[int, int, int], list[tuple[int, int]]] = {}

    # long matches that follow one another in both texts are one stretch that is known to agree
    k, r, a, d = (c[is_long] for c in (key, ref, x, x - y))
    order = np.lexsort((a, d, r, k))
    k, r, a, d = (c[order] for c in (k, r, a, d))
    if len(k):
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (d[1:] != d[:-1]) | (a[1:] > a[:-1] + size)
        start = np.flatnonzero(new)
        begin, end, owner, source = a[start], a[np.append(start[1:], len(a)) - 1] + size, k[start], r[start]
        known = (end - begin >= min_words) & (source != owner)
        for o, r_, d_, i, j in zip(*(c[known].tolist() for c in (owner, source, d[start], begin, end)), strict=True):
            out.append((o, r_, -1, [i], [j]))
            whole.setdefault((o, r_, d_), []).append((i, j))
        # windows that hold one of its seeds; of a stretch that holds windows itself those that stick out of it
        pieces = [(owner[~known], (begin - min_words + size)[~known], (end - size)[~known])]
        pieces += [(owner[known], (begin - min_words + size)[known], begin[known] - 1), (owner[known], (end - min_words + 1)[known], (end - size)[known])]
        owner, lo, hi = (np.concatenate(c) for c in zip(*pieces, strict=True))
        words = sizes[np.searchsorted(keys, owner)]
        lo, hi = np.maximum(lo, 0), np.minimum(hi, words - min_words)
        kept = lo <= hi
        owner, lo, hi, words = (c[kept] for c in (owner, lo, hi, words))
        order = np.argsort(owner, kind="stable")
        owner, lo, hi, words = (c[order] for c in (owner, lo, hi, words))
        if len(owner):
            for i, j in zip(*grouped(owner), strict=True):
                out.append((int(owner[i]), None, int(words[i]), lo[i:j].tolist(), hi[i:j].tolist()))

    # chains of short seeds of two documents
    words = dict(zip(keys.tolist(), sizes.tolist(), strict=True))
    covered: dict[int, list[tuple[int, int]]] = {}
    for (k, _, _), spans in whole.items():
        covered.setdefault(k, []).extend(spans)
    other = (ref != key) & ~is_long
    first = key[other], ref[other], x[other], y[other]
    made = list(paired(*first, least_span))
    for k, _, xs, ys in made:
        covered.setdefault(k, []).extend(dense(xs, ys, min_words))
    left = other.copy()
    left[left] = ~inside(key[left], x[left], covered)
    for i, j in zip(*grouped(key[left]), strict=True) if left.any() else ():
        out.append((int(key[left][i]), int(key[left][i]), LEFT, np.unique(x[left][i:j]).tolist(), [words[int(key[left][i])]]))
    second = (prev != key) & ~is_long
    second[second] = ~inside(key[second], x[second], covered)
    if second.any():
        # a pair that has a match with a row before is chained anew, of matches of both kinds
        anew = set(zip(key[second].tolist(), prev[second].tolist(), strict=True))
        both = np.fromiter((p in anew for p in zip(first[0].tolist(), first[1].tolist(), strict=True)), bool, len(first[0]))
        parts = ((c[both], d[second]) for c, d in zip(first, (key, prev, x, prev_place >> AT), strict=True))
        made = [m for m in made if m[:2] not in anew] + list(paired(*map(np.concatenate, parts), least_span))
    for k, r, xs, ys in made:
        # what is known to agree from one end to the other needs no alignment
        d = xs[0] - ys[0]
        if any(lo <= xs[0] and xs[-1] + K <= hi for lo, hi in whole.get((k, r, d), ())) and all(i - j == d for i, j in zip(xs, ys, strict=True)):
            continue
        out.append((k, r, words[k], xs, ys))
    return out


def inside(key: np.ndarray, x: np.ndarray, spans: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Whether the K words from x on lie in one of the spans of their key."""
    out = np.zeros(len(key), bool)
    if not len(key):
        return out
    for i, j in zip(*grouped(key), strict=True):  # rows of a key are together
        own = spans.get(int(key[i]))
        if own:
            starts, ends = (np.array(c) for c in zip(*joined_spans(own), strict=True))
            at = np.searchsorted(starts, x[i:j], side="right") - 1
            out[i:j] = (at >= 0) & (x[i:j] + K <= ends[at])
    return out


def chained(matches: DataFrame, min_words: int, least_span: int) -> DataFrame:
    """FOUND of rows (key, place, ref, ref_place, prev, prev_place), those of a key in one partition and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_keys(batches):
            yield handed(found_in(*columns, min_words, least_span))
        yield handed([])

    return matches.mapInArrow(run, FOUND)


def left_seeds(rows: DataFrame) -> DataFrame:
    """key, seed, place of the seeds at the words xs of rows (key, text, xs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            counts, found, places = [], [], []
            for text, xs in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                at = np.array(xs, np.int64)
                counts.append(len(at))
                found.append(rolled(word_numbers(text), K)[at])
                places.append(at << AT)
            yield numbers(batch.column(0), counts, found, places)

    return rows.mapInArrow(run, "key long, seed long, place long")


def one_a_stretch(columns: list[np.ndarray], least: int) -> list[np.ndarray]:
    """Of the rows (pair, key, both, is_left) of one pair and text that begin in the same ``least`` words the first, a left one if there is one."""
    pair, key, both, is_left = columns
    stretch = (both >> AT) // max(1, least)
    order = np.lexsort((both, ~is_left, stretch, pair, key))
    new = np.ones(len(key), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (key, pair, stretch)], axis=0)
    return [c[order][new] for c in columns]


def pairs_of(key: np.ndarray, seed: np.ndarray, x: np.ndarray, is_left: np.ndarray, least: int) -> pa.RecordBatch:
    """pair, key, both (the first word above the second), is_left (of both) of the seeds of a text that are least to FAR words
    apart; rows that are there twice count once, as left if one of them is. Of one pair that begins more than once in ``least`` words,
which overlaps with itself and so is of a text that goes round, the first one counts."""
    order = np.lexsort((~is_left, seed, x, key))
    key, seed, x, is_left = (c[order] for c in (key, seed, x, is_left))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (seed[1:] != seed[:-1]) | (x[1:] != x[:-1])
    key, seed, x, is_left = (c[new] for c in (key, seed, x, is_left))
    made: list[list[np.ndarray]] = []
    for step in range(1, len(key)):
        same = key[step:] == key[:-step]
        apart = np.where(same, x[step:] - x[:-step], FAR + 1)
        if not (apart <= FAR).any():
            break
        i = np.flatnonzero((apart >= least) & (apart <= FAR))
        pair = mixed(mixed(seed[i].view(np.uint64)) + ODD * seed[i + step].view(np.uint64)).view(np.int64)
        made.append(one_a_stretch([pair, key[i], (x[i] << AT) | x[i + step], is_left[i] & is_left[i + step]], least))
    columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [key[:0], key[:0], key[:0], is_left[:0]]
    columns = one_a_stretch(columns, least)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pair", "key", "both", "is_left"])


def seed_pairs(rows: DataFrame, least: int) -> DataFrame:
    """pairs_of rows (key, seed, place, is_left), those of a key in one partition and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, seed, place, is_left in whole_keys(batches):
            yield pairs_of(key, seed, place >> AT, is_left.astype(bool), least)

    return rows.mapInArrow(run, "pair long, key long, both long, is_left boolean")


#: All chains of two texts.
CHAINS = "key long, ref long, words int, xs array<array<int>>, ys array<array<int>>"


def chained_pairs(matches: DataFrame, least_span: int) -> DataFrame:
    """CHAINS of rows (key, ref, both, ref_both), those of a key in one partition and together; each key has a row with its number
    of words, as -1 - n, in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << AT) - 1
        for key, ref, both, ref_both in whole_keys(batches):
            told = both < 0
            words = dict(zip(key[told].tolist(), (-1 - both[told]).tolist(), strict=True))
            key, ref, both, ref_both = (c[~told] for c in (key, ref, both, ref_both))
            every = np.tile(key, 2), np.tile(ref, 2), np.append(both >> AT, both & low), np.append(ref_both >> AT, ref_both & low)
            order = np.lexsort(every[::-1])
            every = [c[order] for c in every]
            new = np.ones(len(order), bool)  # a match of several pairs counts once
            new[1:] = np.any([c[1:] != c[:-1] for c in every], axis=0)
            out: list[tuple] = []
            for k, r, xs, ys in paired(*(c[new] for c in every), least_span):
                if not out or out[-1][:2] != (k, r):
                    out.append((k, r, words[k], [], []))
                out[-1][3].append(xs)
                out[-1][4].append(ys)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), lists, lists), strict=True)], names=["key", "ref", "words", "xs", "ys"])

    return matches.mapInArrow(run, CHAINS)


def rest_of_chains(found: DataFrame, spans: DataFrame, seeds_: DataFrame, texts: DataFrame, least_span: int) -> DataFrame | None:
    """CHAINS of the seeds in words that the passages spans (key, start, end) don't cover, with all earlier texts."""
    gone = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    left = found.where(F.col("words") == LEFT).select("key", "xs", F.col("ys")[0].alias("n")).join(gone, "key", "left")
    is_gone = lambda x: F.exists(F.col("spans"), lambda s: (s["start"] <= x) & (x + K <= s["end"]))
    left = left.select("key", "n", F.when(F.col("spans").isNull(), F.col("xs")).otherwise(F.filter("xs", lambda x: ~is_gone(x))).alias("xs"))
    left = common.written(left.where(F.size("xs") > 1), "left")
    if left.isEmpty():
        return None
    near = common.Filter(left, "key").split(texts, "key")[0].join(common.small_or_shuffled(left.drop("n")), "key").select("key", "text", "xs")
    late = common.written_in_small_batches(left_seeds(near), "left-seeds")
    known = common.small_or_shuffled(common.written(late.select("seed").distinct(), "left-kinds"))
    short = seeds_.where((F.col("place") >= 0) & (F.col("place").bitwiseAND(1) == 0)).join(known, "seed").select("key", "seed", "place")
    every = short.withColumn("is_left", F.lit(False)).unionByName(late.withColumn("is_left", F.lit(True)))
    pairs = common.written(seed_pairs(every.repartition("key").sortWithinPartitions("key"), least_span - K), "pairs")
    asked = pairs.where("is_left").select("pair", "key", "both")
    earlier = common.Filter(asked, "pair").split(pairs, "pair")[0].select("pair", F.col("key").alias("ref"), F.col("both").alias("ref_both"))
    matches = asked.join(earlier, "pair").where("ref < key").select("key", "ref", "both", "ref_both")
    sizes = left.select("key", F.col("key").alias("ref"), (-1 - F.col("n")).cast("long").alias("both"), F.lit(0).cast("long").alias("ref_both"))
    return chained_pairs(matches.unionByName(sizes).repartition("key").sortWithinPartitions("key"), least_span)


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """key, seed, place of the windows of min_words words that begin between firsts and lasts, of rows (key, text, firsts,
    lasts); below the place is the number of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            counts, found, places = [], [], []
            for text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = word_numbers(text)
                wanted = np.zeros(len(words) - min_words + 2, np.int64)  # what lies in several of them is there once
                np.add.at(wanted, firsts, 1)
                np.add.at(wanted, np.array(lasts) + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted))
                counts.append(len(at))
                found.append(window_hashes(words, min_words, at))
                places.append((at << AT) | len(words))
            yield numbers(batch.column(0), counts, found, places)

    return rows.mapInArrow(run, "key long, seed long, place long")


def segments(matches: DataFrame, min_words: int) -> DataFrame:
    """key, ref, start, end (words) of matched windows: those of one other document that touch or overlap are one."""
    names = ["key", "ref", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, place, ref, _ in whole_keys(batches):
            x = place >> AT
            order = np.lexsort((x, ref, key))
            key, ref, x = key[order], ref[order], x[order]
            new = np.ones(len(x), bool)  # windows are of one length, so each is compared with the one before
            new[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]) | (x[1:] > x[:-1] + min_words)
            start = np.flatnonzero(new)
            columns = key[start], ref[start], x[start].astype(np.int32), (x[np.append(start[1:], len(x)) - 1] + min_words).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return matches.mapInArrow(run, "key long, ref long, start int, end int")


def matched_words(a: list[int], b: list[int]) -> int:
    """Words that stay in place in a least edit of a to b (no replaced word counts)."""
    if a == b:
        return len(a)
    row = [(j, 0) for j in range(len(b) + 1)]  # (edits, -matches), so the least of the best edits has most matches
    for i, word in enumerate(a, 1):
        above, row = row, [(i, 0)]
        for j, other in enumerate(b, 1):
            d, m = above[j - 1]
            same = (d, m - 1) if word == other else (d + 1, m)
            row.append(min(same, (above[j][0] + 1, above[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
    return -row[-1][1]


#: Words that either text may have more of where an extension goes on behind words that differ, and words that must agree there.
SLIP, AGREE = 8, 3


def slipped(a: list[int], b: list[int]) -> tuple[int, int] | None:
    """The nearest places behind the first ones from which AGREE words are equal, if either text has SLIP words more at most."""
    a, b = a[: SLIP + AGREE], b[: SLIP + AGREE]
    grams = [list(zip(*(c[k:] for k in range(AGREE)), strict=False)) for c in (a, b)]
    if set(grams[0]).isdisjoint(grams[1]):
        return None
    for far in range(1, 2 * SLIP + 1):
        for x in range(max(0, far - SLIP), min(SLIP, far) + 1):
            y = far - x
            if x < len(grams[0]) and y < len(grams[1]) and grams[0][x] == grams[1][y]:
                return x, y
    return None


def ahead(a: list[int], at: int, step: int) -> list[int]:
    """The words from a[at] on that a slip can reach, or with a step of -1 those from it back."""
    return a[at : at + SLIP + AGREE] if step > 0 else a[max(0, at + 1 - SLIP - AGREE) : at + 1][::-1]


def extension(a: list[int], b: list[int], drop: int = 6, slips: bool = False, x: int = 0, y: int = 0, step: int = 1) -> tuple[int, int, int]:
    """How far two lists agree from a[x] and b[y] on, or with a step of -1 from there back, in words of each, and how many agree: a match
    earns 1, a replaced word costs 2, and the end is where the sum was largest; ``drop`` below its peak the search ends. With slips it goes
    on where words agree again a few places on, if that earns more than it costs. The lists aren't copied, as most searches end soon."""
    room = (len(a) - x, len(b) - y) if step > 0 else (x + 1, y + 1)
    total = best = seen = 0
    at = end = (0, 0, 0)  # where a stretch without a slip begins, and the best end so far
    while True:
        total_before, peak = best, total
        p, q = x + step * at[0], y + step * at[1]
        for i in range(1, min(room[0] - at[0], room[1] - at[1]) + 1):
            if a[p] == b[q]:
                seen += 1
                total += 1
            else:
                total -= 2
            p, q = p + step, q + step
            if total > best:
                best, end = total, (at[0] + i, at[1] + i, seen)
            if total > peak:
                peak = total
            elif total < peak - drop:
                break
        if not slips or (at != (0, 0, 0) and best == total_before):
            return end
        to = slipped(ahead(a, x + step * end[0], step), ahead(b, y + step * end[1], step))
        if to is None:
            return end
        at, seen = (end[0] + to[0], end[1] + to[1], end[2]), end[2]
        total = best - 2 * max(to)


def matched_in_rows(a: list[int], b: list[int]) -> int:
    """matched_words of long lists, a row at a time: edits and matches in one number."""
    big = 1 << 32
    other, steps = np.array(b, np.int64), np.arange(len(b) + 1) * big
    row = steps
    for word in a:
        new = row + big
        np.minimum(new[1:], row[:-1] + np.where(other == word, -1, big), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(-row[-1] % big)


def parts(words: list[int], ref: list[int], xs: list[int], ys: list[int], min_words: int, similarity: float) -> list[tuple[int, int]]:
    """Start and end of the passages of a chain, in words; ys are places in ref.

    A chain is made of pieces without a difference and of gaps between them. Passages are runs of pieces of at least
    min_words words of which similarity match, ends extended as far as words agree. They are chosen to cover the most
    words, then the fewest others in gaps that don't align, then to be few: so a chain is cut at
    such gaps, unless it takes both sides to make a passage.
    """
    pieces: list[list[int]] = []  # x, y of its start, x, y of its end, matches
    between: list[tuple[int, int, int, int]] = []  # the gap behind each piece
    x_at, y_at = xs[0], ys[0]
    for x, y in zip(xs, ys, strict=True):
        begin = max(x, x_at)
        gap = (x_at, begin, y_at, max(y, y_at))
        if not pieces or words[x_at:begin] != ref[y_at : gap[3]]:
            if pieces:
                between.append(gap)
            pieces.append([begin, y + begin - x, 0, 0, 0])
        else:
            pieces[-1][4] += begin - x_at
        pieces[-1][4] += max(0, x + K - begin)
        x_at, y_at = max(x_at, x + K), max(y_at, y + K)
        pieces[-1][2:4] = x_at, y_at
    begin, end = extension(words, ref, slips=True, x=xs[0] - 1, y=ys[0] - 1, step=-1), extension(words, ref, slips=True, x=x_at, y=y_at)
    if x_at + end[0] - xs[0] + begin[0] < min_words:
        return []
    sure = sum(p[4] for p in pieces) + begin[2] + end[2]
    most = [min(x_end - x, y_end - y) for x, x_end, y, y_end in between]  # words that match in a gap at most
    if sure + sum(most) < similarity * min_words:  # too few for any passage
        return []
    for i, (x, x_end, y, y_end) in enumerate(between):
        if most[i] > 1:  # those that both have, in any order
            most[i] = (Counter(words[x:x_end]) & Counter(ref[y:y_end])).total()
    total = sure + sum(most)
    if total < similarity * min_words:
        return []
    left, right = np.zeros((len(pieces), 3), np.int64), np.zeros((len(pieces), 3), np.int64)
    left[0], right[-1] = begin, end
    # of the pieces before each one: matches, those that count for the choice, words of gaps that don't align, first in reach
    seen, counted, others, reach = (np.zeros(len(pieces), np.int64) for _ in range(4))
    for i, (x, x_end, y, y_end) in enumerate(between):
        a, b = words[x:x_end], ref[y:y_end]
        size = max(len(a), len(b))
        right[i] = extension(a, b, slips=size > DROP)
        left[i + 1] = extension(a[::-1], b[::-1], slips=size > DROP)
        far = similarity * (total + size - most[i]) > total  # no passage can have it
        same = 0 if far else matched_words(a, b) if len(a) * len(b) <= 4096 else matched_in_rows(a, b)
        wide = size - same > max(DROP, same)
        seen[i + 1] = seen[i] + pieces[i][4] + same
        counted[i + 1] = counted[i] + pieces[i][4] + (0 if wide else same)
        others[i + 1] = others[i] + (size - same if wide else 0)
        reach[i + 1] = i + 1 if far else reach[i]
    start_x, start_y, end_x, end_y, own = np.array(pieces, np.int64).T
    start_x, start_y, end_x, end_y = start_x - left[:, 0], start_y - left[:, 1], end_x + right[:, 0], end_y + right[:, 1]
    last = len(pieces) - 1
    size = max(end_x[-1] - start_x[0], end_y[-1] - start_y[0])
    if not others[-1] and not reach[-1] and end_x[-1] - start_x[0] >= min_words and seen[-1] + own[-1] + left[0, 2] + right[-1, 2] >= similarity * size:
        return [(int(start_x[0]), int(end_x[-1]))]
    best, chosen = np.zeros(len(pieces) + 1, np.int64), [-1] * len(pieces)
    for j in range(last + 1):
        best[j + 1] = best[j]
        at = slice(reach[j], j + 1)
        spans = end_x[j] - start_x[at]
        matches = seen[j] + own[j] + right[j, 2] - seen[at] + left[at, 2]
        fits = np.flatnonzero((spans >= min_words) & (matches >= similarity * np.maximum(spans, end_y[j] - start_y[at])))
        if len(fits):
            i = fits + reach[j]
            values = best[i] + ((counted[j] + own[j] - counted[i]) << 24) - 2 * (others[j] - others[i]) - 1
            k = int(np.argmax(values))
            if values[k] > best[j]:
                best[j + 1], chosen[j] = values[k], int(i[k])
    out, j = [], last
    while j >= 0:
        if chosen[j] < 0:
            j -= 1
        else:
            out.append((int(start_x[chosen[j]]), int(end_x[j])))
            j = chosen[j] - 1
    return out[::-1]


def narrow(words: np.ndarray) -> np.ndarray:
    """31 bits of each word number: enough to align by, and half the bytes to move."""
    return (words & np.uint64(0x7FFFFFFF)).astype(np.int32)


WORD = re.compile(r"\S+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space behind each of them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end][0] if end < len(places) else len(text)
    out.append(text[at:])
    return "".join(out)


def reach(words: int) -> int:
    """Words of the earlier text that as many words of the later one can be like: slips make them more."""
    return words + words // 4 + SLIP


def of_two_texts(found: DataFrame) -> DataFrame:
    """CHAINS of rows of FOUND that are chains."""
    every = found.groupBy("key", "ref").agg(F.first("words").alias("words"), F.collect_list(F.struct("xs", "ys")).alias("all"))
    return every.select("key", "ref", "words", F.col("all")["xs"].alias("xs"), F.col("all")["ys"].alias("ys"))


def aligned(found: DataFrame, rows: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """key, ref, start, end (words) of the passages of the chains in a written table, FOUND or CHAINS; rows (key, text) are the
    documents.

    Of the earlier text go on only the words that a passage can reach, which are no more than the later text has on
    either side of a chain; then they meet the later text. The chains of two texts, of which texts that repeat themselves have
    many, are one row all the way, so they share the texts.
    """
    refs = common.Filter(found, "ref").split(rows, "key")[0]
    every = found if found.schema["xs"].dataType.elementType.typeName() == "array" else of_two_texts(found)
    asked = common.spread(every, refs, "ref", "key", common.hot_values(found, "ref"), "key").select("key", "ref", "words", "xs", "ys", "text")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=5):
            out: tuple[list, list] = ([], [])
            text_before, words = None, np.zeros(0, np.int32)
            for n, xs, ys, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if text != text_before:
                    text_before, words = text, narrow(word_numbers(text))
                start = max(0, min(y[0] - reach(x[0]) for x, y in zip(xs, ys, strict=True)))
                out[0].append([[y - start for y in chain] for chain in ys])
                out[1].append(words[start : max(y[-1] + reach(n - x[-1]) for x, y in zip(xs, ys, strict=True))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out[0], pa.list_(pa.list_(pa.int32()))), pa.array(out[1], pa.list_(pa.int32()))], names=["key", "ref", "xs", "ys", "ref_words"])

    # dealt by key in any case: where the join takes a broadcast, a task would hold the workers and batches of both steps
    with_words = asked.mapInArrow(cut_out, "key long, ref long, xs array<array<int>>, ys array<array<int>>, ref_words array<int>").repartition("key")
    later = common.Filter(found, "key").split(rows, "key")[0]
    both = with_words.join(later, "key").select("key", "ref", "xs", "ys", "ref_words", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, rows=200, text=5):
            out: list[tuple] = []
            text_before, words = None, []
            for row in zip(*batch.columns, strict=True):  # a row at a time: words take ten times the room as Python's numbers
                key, ref, xs, ys, text = (row[i].as_py() for i in (0, 1, 2, 3, 5))
                ref_words = row[4].values.to_numpy().tolist()
                if text != text_before:
                    text_before, words = text, narrow(word_numbers(text)).tolist()
                spans = (span for x, y in zip(xs, ys, strict=True) for span in parts(words, ref_words, x, y, min_words, similarity))
                out += [(key, ref, *span) for span in dict.fromkeys(spans)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "ref", "start", "end"])

    return both.mapInArrow(align, "key long, ref long, start int, end int")


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(end, joined[-1][1])
        else:
            joined.append((start, end))
    return joined


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc, text, times: one row for each distinct doc_id and text, with how often the table has it. Keys are in the
    order of doc_id, nulls last, and of a hash of the text; they are the doc_ids themselves if these are all different."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), common.text_of(text_col).alias("text"))
    if rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("doc is null or n > 1").isEmpty():
        return rows.select(F.col("doc").alias("key"), "doc", "text", F.lit(1).cast("long").alias("times"))
    distinct = rows.groupBy("doc", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    return common.written(distinct.orderBy(F.col("doc").asc_nulls_last(), "hash").select(F.monotonically_increasing_id().alias("key"), "doc", "text", "times"), "keyed")


def copies_of(texts: DataFrame) -> DataFrame:
    """key, ref: the rows (key, text) whose text a smaller key has too, each with the smallest such key."""
    digests = common.written(texts.select("key", F.md5("text").alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("key").alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return common.written(common.lookup(digests, first, "digest", common.hot_list(digests, "digest")).where("key <> ref").select("key", "ref"), "copies")


def without(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows (key, text) that aren't copies."""
    maybe, clean = common.Filter(copies, "key").split(texts, "key")
    return clean.unionByName(maybe.join(common.small_or_shuffled(copies.select("key")), "key", "left_anti"))


def substring_dedup(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", least_span: int | None = None) -> DataFrame:
    """doc_id, n_words, spans array<struct<start, end>> (words), n_removed, ref_ids array<long>, kept_text, hash.

    One row for each row of docs. Of a passage that several documents have, the first one (smallest doc_id; a null
    doc_id is last) keeps it, with its own repeats; later documents lose each copy. hash is xxhash64 of the text: rows
    are known by doc_id and hash, so rows that repeat a doc_id with other texts are documents of their own, and with the
    same text are one document that all of them show. Null texts are empty; an empty table gives no rows; other columns
    aren't read. A task holds the matches of one document at a time, which its own length bounds. Chains whose seeds span less than
    least_span words (without it, min_words - 2 * (WINDOW - 1)) aren't aligned: a lower one finds passages whose equal words lie
    close together, at the price of more alignments; two seeds are needed in any case.
    """
    least_span = max(K + 1, min_words - 2 * (WINDOW - 1)) if least_span is None else least_span
    rows = keyed(docs, id_col, text_col)
    texts = rows.select("key", "text")
    copies = copies_of(texts)
    seeds_ = common.written_in_small_batches(seeds(without(texts, copies), min_words), "seeds")
    sizes = seeds_.where("place < 0").select("key", "place", *(F.lit(0).cast("long").alias(c) for c in ("ref", "ref_place", "prev", "prev_place")))
    matches = with_first(seeds_.where("place >= 0"), own=True).unionByName(sizes)
    found = common.written(chained(matches.repartition("key").sortWithinPartitions("key"), min_words, least_span), "chains")
    asked = found.where("ref is null").select("key", F.col("xs").alias("firsts"), F.col("ys").alias("lasts"))
    around = common.Filter(asked, "key").split(texts, "key")[0].join(common.small_or_shuffled(asked), "key").select("key", "text", "firsts", "lasts")
    matched = with_first(common.written_in_small_batches(windows(around, min_words), "windows")).where("ref <> key").select("key", "place", "ref", "ref_place")
    exact = segments(matched.repartition("key").sortWithinPartitions("key"), min_words)
    known = found.where("words = -1").select("key", "ref", F.col("xs")[0].alias("start"), F.col("ys")[0].alias("end"))
    every = common.written(found.where("ref is not null and words >= 0"), "all-chains")
    spans = common.written_in_small_batches(aligned(every, texts, min_words, similarity).unionByName(exact).unionByName(known), "passages")
    counts = seeds_.where("place < 0").select("key", (-1 - F.col("place")).cast("int").alias("n"))
    rest = rest_of_chains(found, spans, seeds_, texts, least_span)
    if rest is not None:
        rest = common.written(rest, "rest-of-chains")
        spans = common.written_in_small_batches(spans.unionByName(aligned(rest, texts, min_words, similarity)), "passages")
    whole = common.lookup(copies, counts.withColumnRenamed("key", "ref"), "ref", common.hot_list(copies, "ref")).where(F.col("n") >= min_words)
    spans = common.written(spans.unionByName(whole.select("key", "ref", F.lit(0).alias("start"), F.col("n").alias("end"))), "passages")
    refs = spans.select("key", "ref").distinct().join(rows.select(F.col("key").alias("ref"), "doc"), "ref").groupBy("key").agg(F.sort_array(F.collect_set("doc")).alias("refs"), F.count_if(F.col("doc").isNull()).alias("unnamed"))
    listed = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(refs, "key")
    hit, clean = common.Filter(spans, "key").split(rows, "key")
    nothing = [F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in ("spans", "refs", "unnamed")]
    both = hit.join(listed, "key", "left").select("doc", "text", "times", "spans", "refs", "unnamed").unionByName(clean.select("doc", "text", "times", *nothing))
    both = both.select("doc", "text", "spans", F.when(F.col("unnamed") > 0, F.concat("refs", F.array(F.lit(None).cast("long")))).otherwise(F.col("refs")).alias("refs"), F.xxhash64("text").alias("hash"), "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), span, pa.int64(), pa.list_(pa.int64()), pa.string())
        for batch in common.sliced(batches, text=1):
            out: list[tuple] = []
            for text, listed_, refs_, times in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                removed = joined_spans([(s["start"], s["end"]) for s in listed_ or []])
                row = (len(text.split()), [{"start": s, "end": e} for s, e in removed], sum(e - s for s, e in removed), refs_ or [], cut(text, removed) if removed else text)
                out += [row] * times
            take = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(5).to_numpy()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(4).take(take)], names=["doc_id", "n_words", "spans", "n_removed", "ref_ids", "kept_text", "hash"])

    return both.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, n_removed long, ref_ids array<long>, kept_text string, hash long")
