"""N-gram Jaccard self-join by chosen paths.

A set is the five-word shingles of a text; texts with one and the same set are one set from the start. In each run a
set walks down paths: at every step it samples those of its tokens whose hash, seeded by the path so far, lies below a
rate over their number. Sets that share most tokens sample mostly the same ones, and meet. A bucket is the sets at one
path; large buckets are split one step further, small ones are compared by brute force. What is still large after the
last step holds sets that are alike; it is compared in blocks, so no task holds a whole bucket. Runs are repeated until
the chance to miss a pair at the least similarity is below 1 - recall.

Each pair is counted in one bucket alone, the smallest that both sets are in; buckets pass on counts and, as edges of
a forest, which sets hang together, never pairs. Links are verified on whole sets, so there are no false ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm import common
from quillmere.llm.shingles import fingerprint, mixed, shingle_set

#: Expected samples of a set at each step of a path.
RATES = (2.5, 1.6, 1.6)
#: Sets of a bucket that isn't split further; sets and tokens of a block that is compared at once.
LIMIT, BLOCK, BLOCK_TOKENS = 128, 1000, 500_000
#: Columns of an incidence matrix that are multiplied at once, and hashes of tokens that are made at once.
COLUMNS, HASHES = 2048, 1 << 20

ONE = np.uint64(1)


def runs_needed(similarity: float, recall: float) -> int:
    """A pair shares a sampled token with a chance of 1 - exp(-rate * share), where share is the part of the larger
    set that is shared, least where one set holds the other: the similarity; from the last step to the first."""
    share, found = similarity, 1.0
    for rate in reversed(RATES):
        found = 1 - math.exp(-rate * share * found)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def sampled(tokens: np.ndarray, seeds: np.ndarray, rate: float) -> list[np.ndarray]:
    """For each seed of a path the seeds of the paths that go on from it: a token whose hash is below a rate over the
    number of tokens is sampled."""
    bound = np.uint64(min(1.0, rate / len(tokens)) * (1 << 53))
    step, out = max(1, HASHES // len(tokens)), []
    for start in range(0, len(seeds), step):
        some = seeds[start : start + step]
        chosen = (mixed(tokens ^ some[:, None]) >> np.uint64(11)) < bound
        out += [mixed(tokens[row] + after) for row, after in zip(chosen, mixed(some + ONE), strict=True)]
    return out


def first_paths(tokens: np.ndarray, runs: int) -> np.ndarray:
    """Of one step, over all runs."""
    return np.concatenate(sampled(tokens, mixed(np.arange(1, runs + 1, dtype=np.uint64)), RATES[0])).view(np.int64)


def sketches(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """doc, h, fp (null without words), number of tokens and the first paths of each row of (doc, text, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=1):
            prints, sizes, drawn = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text or "", n)
                prints.append(fingerprint(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                drawn.append(first_paths(tokens, runs) if len(tokens) else tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(drawn, pa.list_(pa.int64()))], names=["doc", "h", "fp", "tokens", "paths"])

    return docs.mapInArrow(run, "doc long, h long, fp binary, tokens long, paths array<bigint>")


def deeper(large: DataFrame, texts: DataFrame, n: int, rate: float) -> DataFrame:
    """path, fp: the paths one step below those of large buckets; each text is moved once, whatever its buckets."""
    asked = large.groupBy("fp").agg(F.collect_list("path").alias("paths")).join(texts, "fp").select("fp", "paths", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text=2):
            drawn, counts = [np.zeros(0, np.uint64)], []
            for fp, paths, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = shingle_set(text, n)
                below = np.zeros(0, np.uint64)
                if fingerprint(tokens) == fp:  # else a text of the same hash
                    below = np.concatenate(sampled(tokens, np.array(paths, np.int64).view(np.uint64), rate))
                drawn.append(below)
                counts.append(len(below))
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(drawn).view(np.int64)), batch.column(0).take(take)], names=["path", "fp"])

    return asked.mapInArrow(run, "path long, fp binary")


def sized(rows: DataFrame, name: str) -> DataFrame:
    """Rows (path, fp, ...) of buckets with two or more sets, with their size; rows is made of a written table. Rows are moved
    once: those of a path are counted where they meet. Rows of hot paths stay where they are, and their counts go to them."""
    hot = common.hot_list(rows, "path")
    is_hot = F.col("path").isin(hot) if hot else F.lit(False)
    met = rows.where(~is_hot).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("path")))
    if hot:
        counts = rows.where(is_hot).groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        met = met.unionByName(rows.where(is_hot).join(F.broadcast(counts), "path"))
    return common.written(met.where("size > 1"), name)


def final_buckets(met: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """path, fp of the buckets that aren't split: small ones, and what is still large after the last step."""
    second = sized(common.written(deeper(met.where(F.col("size") > LIMIT), texts, n, RATES[1]), "deeper"), "second")
    third = sized(common.written(deeper(second.where(F.col("size") > LIMIT), texts, n, RATES[2]), "deeper"), "third")
    small = [df.where(F.col("size") <= LIMIT).select("path", "fp") for df in (met, second)]
    return small[0].unionByName(small[1]).unionByName(third.select("path", "fp")).distinct()


def merged_buckets(final: DataFrame) -> DataFrame:
    """bucket, fp: a bucket most of whose sets have the same bucket as their first one is merged with it. Copies with
    small changes meet in every run in almost the same bucket; so they are compared once, and no pair is lost."""
    lead = final.groupBy("fp").agg(F.min("path").alias("lead"))
    votes = final.join(lead, "fp").groupBy("path", "lead").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("path").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"), F.max("n").alias("most"), F.sum("n").alias("all"))
    label = chosen.select("path", F.when(2 * F.col("most") >= F.col("all"), F.col("lead")).otherwise(F.col("path")).alias("bucket"))
    return common.lookup(final, label, "path", common.hot_list(final, "path")).select("bucket", "fp").distinct()


def dealt_blocks(merged: DataFrame, reps: DataFrame) -> DataFrame:
    """bucket, a, b, side, fp: a and b are the blocks compared there, side the one that fp is in. A bucket is one block
    unless it has more than BLOCK sets or BLOCK_TOKENS tokens."""
    sizes = merged.join(reps.select("fp", "tokens"), "fp").groupBy("bucket").agg(F.count(F.lit(1)).alias("sets"), F.sum("tokens").alias("tokens"))
    count = F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    side = F.pmod(F.xxhash64("fp", "bucket"), count).cast("int")
    dealt = common.lookup(merged, sizes, "bucket", common.hot_list(merged, "bucket")).select("bucket", "fp", side.alias("side"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    return dealt.select("bucket", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the tokens of both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    every = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    tokens, number = np.unique(np.concatenate(every), return_inverse=True)
    numbers = number[: len(every[0])], number[len(every[0]) :]
    shared = np.zeros(len(tokens), bool)
    shared[np.intersect1d(*numbers)] = True
    place = np.cumsum(shared) - 1
    columns = [place[n[shared[n]]] for n in numbers]
    rows = [r[shared[n]] for r, n in zip(rows, numbers, strict=True)]
    order = [np.argsort(c, kind="stable") for c in columns]
    columns, rows = [c[o] for c, o in zip(columns, order, strict=True)], [r[o] for r, o in zip(rows, order, strict=True)]
    for start in range(0, int(shared.sum()), COLUMNS):
        parts = []
        for side, c, r in zip((left, right), columns, rows, strict=True):
            lo, hi = np.searchsorted(c, (start, start + COLUMNS))
            m = np.zeros((len(side), COLUMNS), np.float32)
            m[r[lo:hi], c[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    common_ = overlaps(left, right)
    union = np.array([[len(s)] for s in left]) + np.array([len(s) for s in right]) - common_
    return common_ >= similarity * union - 1e-6


def compared(bucket: int, a: int, b: int, members: list[tuple[int, bytes, list[int], np.ndarray]], similarity: float) -> Iterator[tuple[bytes, bytes, int]]:
    """fp, the first fp that it hangs together with here, and its links that are counted here."""
    sides = ([m for m in members if m[0] == a], [m for m in members if m[0] == b])
    if not sides[0] or not sides[1] or len(members) < 2:
        return
    links = linked([m[3] for m in sides[0]], [m[3] for m in sides[1]], similarity)
    if a == b:
        np.fill_diagonal(links, False)
    if not links.any():
        return
    earlier: dict[int, int] = {}
    for side in sides:
        for m in side:
            for other in m[2]:
                if other < bucket:
                    earlier.setdefault(other, len(earlier))
    counted = links.copy()
    places = [[np.array([earlier[o] for o in m[2] if o < bucket], np.int64) for m in side] for side in sides]
    for start in range(0, len(earlier), COLUMNS):
        inside = []
        for side in places:
            m = np.zeros((len(side), COLUMNS), np.float32)
            for row, at in enumerate(side):
                m[row, at[(at >= start) & (at < start + COLUMNS)] - start] = 1
            inside.append(m)
        counted &= inside[0] @ inside[1].T == 0
    names = sorted({m[1] for m in members})
    index = {fp: i for i, fp in enumerate(names)}
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    rows = [index[m[1]] for m in sides[0]]
    cols = [index[m[1]] for m in sides[1]]
    for i, j in zip(*(x.tolist() for x in np.nonzero(links)), strict=True):
        x, y = find(rows[i]), find(cols[j])
        if x != y:
            root[max(x, y)] = min(x, y)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, rows, counted.sum(axis=1))
    if a != b:
        np.add.at(total, cols, counted.sum(axis=0))
    touched = {rows[i] for i in np.flatnonzero(links.any(axis=1))} | {cols[j] for j in np.flatnonzero(links.any(axis=0))}
    for i in sorted(touched):
        yield names[i], names[find(i)], int(total[i])


def verified(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """fp, root, links from rows (bucket, a, b, side, fp, others, text), a bucket's rows in one partition and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes, int]] = []

        def handed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["fp", "root", "links"])
            out.clear()
            return made

        key, group, known = None, [], {}
        for batch in common.sliced(batches, text=6):
            columns = [c.to_pylist() for c in batch.columns]
            for bucket, a, b, side, fp, others, text in zip(*columns, strict=True):
                if (bucket, a, b) != key:
                    if key:
                        out += compared(*key, group, similarity)
                    key, group, known = (bucket, a, b), [], {}
                if fp not in known:
                    tokens = shingle_set(text or "", n)
                    if fingerprint(tokens) == fp:  # else a text of the same hash
                        known[fp] = True
                        group.append((side, fp, others, tokens))
            if len(out) > 10_000:
                yield handed()
        if key:
            out += compared(*key, group, similarity)
        yield handed()

    return members.mapInArrow(run, "fp binary, root binary, links long")


def ngram_join(docs: DataFrame, similarity: float = 0.8, n: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies, kept, hash for every row of docs.

    class_id is the smallest doc_id among the documents that hang together by links (null if none has one); n_links the number of other
    shingle sets with a Jaccard similarity of at least ``similarity``; n_copies the number of rows with the very same
    set; kept says whether the row is the one of its class that would stay: that with the smallest doc_id (nulls last),
    then hash, which is xxhash64 of the text. A text of one to n - 1 words is one shingle; a text without words (null, empty) links to nothing, is its own
    class and its own copy. Rows may repeat a doc_id, with the same or another text; rows without one take part like
    all others. An empty table gives no rows. Other columns aren't read. Counting the links of one large cluster takes its
    pairs, block by block; nothing else grows faster than the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), common.text_of(text_col).alias("text"), F.xxhash64(common.text_of(text_col)).alias("h"))
    drawn = common.written(sketches(rows, n, runs_needed(similarity, recall)), "sketches")
    made = drawn.where("fp is not null").groupBy("fp")
    # from is the first row with the set, of which the text is taken: texts of one set may differ
    reps = common.written(made.agg(F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "h")).alias("from"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"), F.first("paths").alias("paths")), "sets")
    met = sized(reps.select(F.explode("paths").alias("path"), "fp"), "met")
    key = ["unnamed", "doc", "h"]  # equal also where there is no id
    named = lambda doc, h: (doc.isNull().alias("unnamed"), F.coalesce(doc, F.lit(0)).alias("doc"), h.alias("h"), F.xxhash64(doc, h).alias("at"))
    wanted = common.written(met.select("fp").distinct().join(reps.select("fp", "from"), "fp").select("fp", *named(F.col("from.doc"), F.col("from.h"))), "wanted")
    near = common.Filter(wanted, "at").split(rows.select(*named(F.col("doc"), F.col("h")), "text"), "at")[0]
    known = near.join(common.small_or_shuffled(wanted.drop("at")), key).select("fp", "text")
    # copies of a row are made one in the map tasks; kept by fp, as each join with texts would move them all
    texts, dropped = common.written_by_key(known.groupBy("fp").agg(F.first("text").alias("text")), "fp", "texts")
    final = common.written(final_buckets(met, texts, n), "final-buckets")
    merged = common.written(merged_buckets(final), "merged-buckets")
    met = common.written(dealt_blocks(merged, reps), "blocks")
    others = met.groupBy("fp").agg(F.collect_set("bucket").alias("others"))
    members = met.join(others.join(texts, "fp"), "fp").select("bucket", "a", "b", "side", "fp", "others", "text").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    found = common.written(verified(members, n, similarity), "links")
    dropped()
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    classes = common.components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    named = reps.select("fp", "from", "copies").join(classes.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
    named = named.select("fp", "from", "copies", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = common.written(named.where("copies > 1 or links > 0"), "named")
    lowest = named.groupBy("root").agg(F.min("from").alias("class"))
    named = common.lookup(named, lowest, "root", common.hot_list(named, "root")).select("fp", "class", "links", "copies")
    plain = drawn.select("doc", "h", "fp", common.salt_of("doc", "h").alias("salt"))
    known = plain.join(common.salted(named), ["fp", "salt"], "left")
    return known.select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("class").isNotNull(), F.col("class.doc")).otherwise(F.col("doc")).alias("class_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.col("class").isNull() | (F.col("doc").eqNullSafe(F.col("class.doc")) & (F.col("h") == F.col("class.h")))).alias("kept"),
        F.col("h").alias("hash"),
    )


def oracle_sql(similarity_percent: int = 80, n: int = 5) -> str:
    """ngram_join of the documents table in SQL, by comparing all pairs that share a shingle (of distinct doc_ids)."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')))) END AS s FROM w
),
sets AS (SELECT s, min(doc_id) AS id, count(*) AS copies FROM g WHERE s IS NOT NULL GROUP BY s),
e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {similarity_percent} * (a.n + b.n - count(*))),
r AS (SELECT id, id AS root FROM sets UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id), l AS (SELECT a AS id, count(*) AS links FROM p GROUP BY a)
SELECT g.doc_id, coalesce(c.root, g.doc_id) AS class_id, coalesce(l.links, 0) AS n_links, coalesce(sets.copies, 1) AS n_copies
FROM g LEFT JOIN sets ON g.s = sets.s LEFT JOIN c ON c.id = sets.id LEFT JOIN l ON l.id = sets.id
"""
