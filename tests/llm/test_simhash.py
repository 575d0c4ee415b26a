from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import queries as llm
from quillmere.llm import simhash
from tests.llm.test_llm import LONG, ODD, prose, table
from tests.oracle import DATA, connection, needs_data


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_components(fps, radius=3):
    """Place of the first of a component, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(np.array(fps[:i], np.uint64) ^ np.uint64(a)) <= radius) if i else []:
            a_, b_ = find(i), find(int(j))
            root[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(fps))]


def same_parts(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def crowd(rng, centre, n, most):
    """Fingerprints around a centre."""
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄ \t\n\x0b\x1c é🙂", max_size=60), st.integers(1, 12))
def test_fingerprints_are_those_of_the_definition_in_pieces_of_any_size(text, size):
    assert simhash.fingerprint(text.encode(), size) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text():
    assert simhash.fingerprint(LONG.encode(), 1000) == plain_fingerprint(LONG)


@pytest.mark.parametrize("spread", [2, 5, 30])
def test_a_shard_is_searched_whole(spread):
    rng = random.Random(spread)
    fps = [f for _ in range(12) for f in crowd(rng, rng.getrandbits(64), 60, spread)]
    fps = list(dict.fromkeys(fps))
    got = simhash.linked(np.array(fps, np.uint64))
    assert same_parts(got.tolist(), plain_components(fps))
    assert all(got[g] == g for g in got)


def test_a_crowd_costs_few_comparisons(monkeypatch):
    rng, made = random.Random(1), []
    fps = np.array(list(dict.fromkeys(crowd(rng, rng.getrandbits(64), 6000, 4))), np.uint64)
    whole = simhash.distance
    monkeypatch.setattr(simhash, "distance", lambda a, b: made.append(np.broadcast(a, b).size) or whole(a, b))
    assert len(set(simhash.linked(fps).tolist())) < len(fps) / 2
    assert sum(made) < len(fps) ** 2 / 4


def test_each_pair_shares_a_shard():
    rng = random.Random(3)
    fps = np.array([f for _ in range(400) for f in crowd(rng, rng.getrandbits(64), 4, 3)], np.uint64)
    tree = simhash.fit_tree(fps[::2], 40)
    shards, rows = simhash.dealt(tree, fps)
    assert tree.shards > 30 and set(shards.tolist()) <= set(range(tree.shards))
    inside = {}
    for s, f in zip(shards.tolist(), rows.tolist(), strict=True):
        inside.setdefault(f, set()).add(s)
    distances = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for i, j in np.argwhere(distances <= 3):
        assert inside[int(fps[i])] & inside[int(fps[j])]


def test_what_cannot_be_parted_is_one_shard():
    assert simhash.fit_tree(np.full(500, 9, np.uint64), 10).shards == 1
    few = np.array([sum(1 << b for b in range(8) if i >> b & 1) for i in range(256)], np.uint64)
    assert simhash.fit_tree(few, 16).shards <= 4


def test_components(spark):
    rng = random.Random(5)
    words = prose(1, 8000).split()
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (5, 4000, 7999)]
    rows = [*ODD, (20, " ".join(words)), (21, near[0].upper()), (22, near[1]), (23, near[2]), *((100 + i, prose(500 + i, rng.randint(3, 60))) for i in range(150))]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(table(spark, rows), shard=32).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components(fps)
    least = {p: min((i for (i, _), q in zip(rows, parts, strict=True) if q == p and i is not None), default=None) for p in parts}
    assert got == sorted((i if i is not None else -1, f"{f:016x}", least[p]) for (i, _), f, p in zip(rows, fps, parts, strict=True))
    assert {c for i, _, c in got if i in (1, 2, 3)} == {1} and {c for i, _, c in got if i in (20, 21)} == {20}


def test_ids_are_of_any_kind_and_a_third_may_be_one_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same few words again").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    got = simhash.simhash_components(rows)
    assert got.count() == 3000 and got.where("component_id = 'x'").count() >= 1000


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None)]])
def test_small_tables(spark, rows):
    got = simhash.simhash_components(table(spark, [*rows, (0, "x")]).where("doc_id is null or doc_id > 0"))
    assert [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()] == [(i, "0" * 16, i) for i, _ in rows]


@needs_data
def test_query_against_all_pairs(spark):
    docs = connection().sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    fps = [plain_fingerprint(t) for _, t in docs]
    wanted = [(docs[i][0], f"{f:016x}", docs[p][0]) for i, (f, p) in enumerate(zip(fps, plain_components(fps), strict=True))]
    assert sorted(tuple(r) for r in llm.op11_simhash_components(spark, str(DATA)).collect()) == wanted
