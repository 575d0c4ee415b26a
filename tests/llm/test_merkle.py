from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillmere.llm import merkle
from quillmere.llm import queries as llm
from tests.llm.test_llm import ODD, SCHEMA, table
from tests.oracle import DATA, assert_same, connection, needs_data


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, arity=3):
    """The root, and a path of (left, right) for each leaf."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = level[at[i] // arity * arity : at[i] // arity * arity + arity]
            path.append(("".join(run[: at[i] % arity]), "".join(run[at[i] % arity + 1 :])))
            at[i] //= arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def plain_manifest(rows, arity=3):
    """rows: (doc_id, source, lang, n_chars, text) in any order -> sorted result rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]], arity)
    root, above = plain_tree([trees[n][0] for n in names], arity)
    for name, up in zip(names, above, strict=True):
        for row, path in zip(groups[name], trees[name][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            node = plain_leaf([*row[:4], row[4].replace("\n", "")] if hit else row)
            for left, right in path + up:
                node = h(left, node, right)
            out.append((row[0], plain_leaf(row), trees[name][0], root, h(*(x for s in path + up for x in s)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def made(docs, **how):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.merkle_manifest(docs, {"text": merkle.tampered_text()}, **how).collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest(spark, arity):
    rows = [(i, ["a", "b", None, "Ä", "", "z\U0001f642", "￿"][i % 7 if i < 60 else 0], "en" if i % 3 else None, i * 7, f"text\n{i}" if i % 4 else None) for i in range(130)]
    rows += [(1000, "lone", None, None, ""), (None, "a", "en", 1, "no id\n"), (5, "a", "en", 1, "same id"), (5, "a", "en", 1, "same id")]
    got = made(spark.createDataFrame(rows, SCHEMA.replace("text string, lang string, source string, n_chars long", "source string, lang string, n_chars long, text string")), arity=arity)
    assert got == plain_manifest(rows, arity)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows_and_clashing_columns(spark):
    docs = table(spark, ODD).withColumns({c: F.lit("clash") for c in ("leaf", "grp", "idx", "n", "h", "left", "right", "path", "root", "__now")})
    assert made(docs) == plain_manifest([(i, "s", "en", len(t or ""), t) for i, t in ODD])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_tables(spark, n):
    got = made(table(spark, [(i, "a\nb") for i in range(n + 1)]).where(f"doc_id < {n}"))
    assert got == (plain_manifest([(i, "s", "en", 3, "a\nb") for i in range(n)]) if n else [])


def test_one_group_of_repeated_rows_is_spread_over_ranges(spark):
    same = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same\n").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    nodes = merkle.placed(same.select(merkle.group_key("source").alias("grp"), merkle.leaf_of([F.col(f) for f in merkle.FIELDS]).alias("h")), ["h"])
    assert [r["idx"] for r in nodes.orderBy("idx").select("idx").collect()] == list(range(4000))
    assert made(same) == plain_manifest([(7, "hot", "en", 5, "same\n")] * 4000)


def test_any_change_is_told(spark):
    docs = table(spark, [(i, f"row {i}") for i in range(40)])
    for field, value in (("lang", F.lit("fr")), ("n_chars", F.col("n_chars") + 1), ("text", F.lit(None).cast("string")), ("source", F.lit("t"))):
        changed = {field: F.when(F.col("doc_id") == 17, value).otherwise(F.col(field))}
        assert [r["doc_id"] for r in merkle.merkle_manifest(docs, changed).where("not verified").collect()] == [17]
    assert merkle.merkle_manifest(docs).where("not verified").count() == 0


@needs_data
def test_query_is_the_same_in_sql_and_by_hand(spark):
    con = connection()
    assert_same(llm.op12_merkle_manifest(spark, str(DATA)), llm.ORACLES["op12_merkle_manifest"], con)
    rows = con.sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in llm.op12_merkle_manifest(spark, str(DATA)).collect()), key=str) == plain_manifest(rows)
