from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmere.llm import hard_negatives as hard
from quillmere.llm import queries as llm
from tests.oracle import DATA, assert_same, connection, needs_data

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=100, best=5, clamp=True):
    """All pairs, one by one."""
    able = [(i, v, n) for i, v, n in dict.fromkeys((i, tuple(v) if v is not None else None, n) for i, v, n in rows) if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(x * 256) for x in v], n) for i, v, n in able]
    out = []
    for a, v, n in whole:
        if a % every:
            continue
        scored = [(min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(v, w, strict=True)))), b, m) for b, w, m in whole if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, b, _ in [s for s in scored if s[2] == n][:best]:
            for rank, (q, c, _) in enumerate([s for s in scored if s[2] != n and 80 * p <= 100 * s[0] <= 100 * p][:best], 1):
                out.append((a, b, rank, c, p, q))
    return sorted(out)


def mined(spark, rows, every=100, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "n", "score", "slot", "row", "is_anchor", "anchor")})
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect())


def vectors(seed, n, length=6, labels=4, centres=9):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(centres)]
    return [(i, [float(f"{x + rng.uniform(-0.3, 0.3):.3f}") for x in rng.choice(middle)], rng.randrange(labels)) for i in range(n)]


def as_floats(rows):
    import numpy as np

    return [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, n) for i, v, n in rows]


@pytest.mark.parametrize("rows_at_once", [4096, 7])
def test_against_all_pairs(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(hard, "ROWS", rows_at_once)
    monkeypatch.setattr(hard, "PRODUCTS", 64)
    rows = as_floats(vectors(1, 700))
    got = mined(spark, rows, every=25)
    assert got == plain(rows, every=25) and len(got) > 200


def test_blocks_of_anchors_don_t_matter(spark, monkeypatch):
    rows = as_floats(vectors(2, 300))
    whole = mined(spark, rows, every=20)
    monkeypatch.setattr(hard, "BLOCK_BYTES", 6 * 8 * 4)  # four anchors
    assert mined(spark, rows, every=20) == whole == plain(rows, every=20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.9], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(8, [1.0, 1.0, 1.0], 1), (9, [], 1), (10, [1.0, 0.95], 1), (10, [1.0, 0.95], 1), (10, [1.0, 0.9], 1), (0, [1.0, 0.99], 1), (100, [], 0), (200, [], 0), (300, [-1.0, -1.0], 3)]
    rows = as_floats(rows)
    got = mined(spark, rows)
    assert got == plain(rows)
    assert {g[3] for g in got if g[0] == 0} == {2, 10} and {g[:2] for g in got if g[0] == 100} == {(100, 200)}  # empty vectors score 0 with one another


def test_ties_and_repeated_rows_go_by_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(hard, "ROWS", 16)
    hot = [1.0, 0.5]
    rows = as_floats([(0, hot, 0), (100, hot, 1)] + [(1 + i, hot, 0) for i in range(60)] + [(500 + i, hot, 1) for i in range(60)] + [(900, hot, 1)] * 80)
    random.Random(1).shuffle(rows)
    got = mined(spark, rows)
    assert got == plain(rows)
    assert [g[3] for g in got if g[:2] == (0, 1)] == [100, 500, 501, 502, 503]


def test_scores_that_float64_cannot_hold_are_whole(spark):
    big = 2.0**30
    rows = as_floats([(0, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [big, 2.0], 1), (3, [big, -5.0], 1), (4, [1e30, 1.0], 1), (5, [-1e30, 1.0], 0)])
    assert mined(spark, rows) == plain(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, [(1, [1.0], 0)]) == [] and mined(spark, [(100, [1.0], 0)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert hard.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []


@needs_data
def test_query_is_the_same_in_sql(spark):
    assert_same(llm.op13_hard_negatives(spark, str(DATA)), llm.ORACLES["op13_hard_negatives"], connection())
