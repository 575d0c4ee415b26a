from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmere.llm import bpe, chat, common, exact_dedup, ngram_join, packing, quality_classifier, quality_rules, shingles, substring_dedup, suffix_dedup, toxicity
from quillmere.llm import queries as llm
from quillmere.sources import scratch
from tests.oracle import DATA, assert_same, connection, needs_data

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that clash with names the operators use.
CLASH = ("key", "hash", "score", "fp", "digest", "salt", "kept", "pos")


def table(spark, rows):
    """rows of (doc_id, text), with the columns of documents and clashing ones."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = prose(99, 20_000)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "null id text"), (5, "Same TEXT"), (6, "same text"), (6, "same text"), (7, "sÄme text"), (8, LONG), (9, "a\x00b\x1c é 🙂 <|endoftext|>x")]


# ---- every operator takes odd rows and empty tables --------------------------------------------------------------------

OPERATORS = {
    "quality": lambda spark, d: quality_classifier.score_quality(d, quality_classifier.untrained()),
    "toxicity": lambda spark, d: toxicity.score_toxicity(d, toxicity.Lexicon()),
    "bpe": lambda spark, d: bpe.bpe_encode(d, columns=tuple(bpe.MAKES)),
    "join": lambda spark, d: ngram_join.ngram_join(d),
    "packing": lambda spark, d: packing.best_fit_pack(d),
    "substring": lambda spark, d: substring_dedup.substring_dedup(d),
    "suffix": lambda spark, d: suffix_dedup.suffix_dedup(d),
    "rules": lambda spark, d: quality_rules.quality_rules(d),
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, table(spark, ODD)).collect()
    wanted = sorted(i for i, _ in ODD if i is not None)
    if name == "packing":
        assert sorted({r["doc_id"] for r in got if r["doc_id"] is not None}) == sorted(set(wanted))
    else:
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == wanted and len(got) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [(1, "x")]).where("false")).count() == 0


# ---- exact deduplication -----------------------------------------------------------------------------------------------


def test_exact_groups(spark):
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(table(spark, ODD), keep="largest").where("doc_id is not null").collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True), (8, 8, 1, True)} <= rows
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(table(spark, ODD)).where("doc_id in (5, 6)").collect()} == {5}
    with pytest.raises(ValueError, match="keep"):
        exact_dedup.exact_dedup(table(spark, ODD), keep="first")


def test_clashing_digests_are_told_apart_by_bytes(spark):
    d = table(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])
    weak = exact_dedup.exact_groups(d, F.col("doc_id"), F.col("text"), lambda t: F.when(t == "c", b"\x02").otherwise(b"\x01"))
    assert {(r["ident"], r["keep"], r["size"]) for r in weak.collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}


def test_index_is_compacted_over_several_flushes(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = lambda *pairs: spark.createDataFrame([(d.encode(), i) for d, i in pairs], "digest binary, ident long")
    index.flush(rows(("a", 5), ("b", 1)))
    index.flush(rows(("a", 2)))
    assert {(bytes(r["digest"]), r["keep"], r["size"]) for r in index.compact().collect()} == {(b"a", 2, 2), (b"b", 1, 1)}
    assert {r["ident"]: r["keep"] for r in index.lookup(rows(("a", 9), ("z", 8))).collect()} == {9: 2, 8: None}


def test_only_copies_pass_the_filter(spark):
    rows = common.written(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest")), "digests")
    probed = common.Filter(rows.limit(500), "digest").probe(rows, "digest")
    assert probed.where("__may").join(rows.limit(500), "digest", "left_semi").count() == 500
    assert 500 <= probed.where("__may").count() < 3000
    assert common.Filter(rows.limit(0), "digest").probe(rows, "digest").where("__may").count() == 0


def test_the_least_long_is_an_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    d = table(spark, [(low, "a"), (high, "A"), (None, "a"), (None, "b"), (low, "c")])
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(d, keep="largest").collect()}
    assert got == {(low, high, 3), (high, high, 3), (None, high, 3), (None, None, 1), (low, low, 1)}


def test_without_copies_keeps_whole_rows(spark):
    rows = [(1, "Same"), (2, "same"), (2, "SAME"), (3, "other"), (None, "x"), (None, "X"), (4, None), (5, "")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.without_copies(table(spark, rows), keep="largest").collect())
    assert got == [("2", "SAME"), ("3", "other"), ("5", ""), ("None", "X")]
    assert exact_dedup.without_copies(table(spark, rows)).columns == table(spark, rows).columns


# ---- chat --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
TALK = (
    [(1, i, ("system", "user", "assistant")[min(i, 1) + (i > 1 and i % 2 == 0)], f"turn {i} " + "x" * (40 * i % 300)) for i in range(700)]
    + [(2, 0, "user", None), (2, 1, None, "</s>\\[INST] <|over|>\n <|turn|> \\\\"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 0, "assistant", "no id"), (3, None, "user", "no turn"), (3, 0, "assistant", "y" * 9000)]
)


@pytest.mark.parametrize("budget", [200, 2048])
def test_chat_matches_sql(spark, budget):
    talk = spark.createDataFrame(TALK, TURNS).withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(1))
    con = connection()
    con.sql("CREATE TABLE talk (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO talk VALUES (?, ?, ?, ?)", TALK)
    options = {"budget": budget, "history": 2, "history_tokens": budget // 4}
    assert_same(chat.chat_digests(chat.format_chat(talk, **options)), chat.oracle_sql("SELECT * FROM talk", **options), con)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    windows = chat.format_chat(spark.createDataFrame(TALK[:700], TURNS), budget=400, history_tokens=100).collect()
    assert len(windows) > 10
    for w in windows:
        assert w["text"].startswith(f"{chat.OPEN}system{chat.SEP}turn 0")
        parts = w["text"].split(chat.END)[:-1]
        assert sum(-(-len(p.split(chat.SEP)[1]) // 4) + chat.MARKS for p in parts) <= 400
        assert len(parts) == w["n_turns"] and w["n_repeated"] <= 3


@pytest.mark.parametrize(("budget", "system", "history_tokens"), [(2048, 6400, 512), (300, 40, 200), (300, 1100, 100), (64, 10_000, 16), (120, None, 500)])
def test_no_window_is_over_the_budget_but_for_one_turn(spark, budget, system, history_tokens):
    rng = random.Random(budget)
    talk = [(0, i, ("user", "assistant")[i % 2], "x" * rng.choice([0, 5, 200, 800, 3 * budget, 5 * budget])) for i in range(1, 120)]
    talk += [(1, i, "user", "same") for i in [3] * 40 + [None] * 5]
    if system is not None:
        talk.append((0, 0, "system", "s" * system))
    for w in chat.format_chat(spark.createDataFrame(talk, TURNS), budget=budget, history=3, history_tokens=history_tokens).collect():
        turns = [p.split(chat.SEP) for p in w["text"].split(chat.END)[:-1]]
        tokens = [-(-len(t[1]) // 4) + chat.MARKS for t in turns]
        fresh = len(turns) - w["n_repeated"]
        assert sum(tokens) <= budget or (fresh == 1 and all("system" in t[0] for t in turns[: w["n_repeated"]])), (tokens, fresh)


def test_tokens_of_a_column_count(spark):
    talk = spark.createDataFrame([(1, i, "user", "x") for i in range(10)], TURNS).withColumn("n", F.when(F.col("turn") < 9, 100))
    assert chat.format_chat(talk, budget=200, history=0, history_tokens=0, tokens_col="n").count() > chat.format_chat(talk, budget=200, history=0, history_tokens=0).count()


def test_chat_of_nothing(spark):
    assert chat.chat_digests(chat.format_chat(spark.createDataFrame([], TURNS))).count() == 0


@given(st.text(alphabet="\\<|>/s[]INSTturnover \n", max_size=40))
@settings(max_examples=30, deadline=None)
def test_escapes_are_reversible(spark, text):
    escaped = chat.escaped(F.lit(text))
    out, back = spark.range(1).select(escaped, chat.unescaped(escaped)).first()
    assert back == text and not any(mark in out for mark in chat.CONTROL)


# ---- BPE ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


WORDS = st.lists(st.sampled_from(["th", "in", "an", "er", "'ll", " ", "e", "ing", "<|startoftext|>", "<|endoftext|>", "İ", "Σ", "é", "e\u0301", "ﬁ", "漢", "🙂", "!!", "\x1c", "\u2028", "7", "ß", "\x00", "ǅ"]), max_size=25).map("".join)


@given(st.one_of(WORDS, st.text(max_size=40)))
@settings(max_examples=400, deadline=None)
def test_encoding_is_that_of_the_library(reference, text):
    v = bpe.vocabulary(bpe.default_path())
    text = text.encode("utf-8", "ignore").decode()
    wanted = reference.encode(text, add_special_tokens=False)
    ids = v.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == wanted.ids
    assert v.decode(ids).decode() == reference.decode(wanted.ids, skip_special_tokens=False)


def test_repetitive_words_step_back(reference):
    v = bpe.vocabulary(bpe.default_path())
    for w in ("a" * 300, "ab" * 200, "lolololol" * 20, "zzzzzq" * 30):
        assert [int.from_bytes(v.packed[r], "little") for r in v.backtracked(w + bpe.END)] == reference.encode(w, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(Path(bpe.default_path()).read_text())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Vocabulary(str(tmp_path / "other.json"))


def test_decode_is_a_query_too(spark):
    d = table(spark, ODD)
    both = bpe.bpe_decode(bpe.bpe_encode(d)).withColumnRenamed("text", "back").join(bpe.bpe_encode(d, columns=("decoded",)), "doc_id")
    assert both.where("back <> decoded and doc_id <> 6").count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=100, deadline=None)
def test_packing_is_whole_gapless_and_no_worse_than_best_fit(lengths):
    n = np.array(lengths, np.int64)
    bins, offsets = packing.pack(n, 100)
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert offsets[mine].tolist() == (np.cumsum(n[mine]) - n[mine]).tolist() and n[mine].sum() <= 100
    assert len(set(bins.tolist())) <= len(packing.best_fit_decreasing(n, 100))


@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_no_step_is_left(lengths):
    """Of the packing that the search ends with, every move or exchange of the four kinds lowers the squared fill."""
    n, capacity = np.array(lengths), 12
    bins = [[i] for i in range(len(n))]
    bins = packing.empty_bins(bins, n, capacity)
    if len(bins) == -(-n.sum() // capacity):
        return
    fill = [int(n[b].sum()) for b in bins]
    some = lambda b, most: [()] + [(i,) for i in b] + ([(i, j) for i in b for j in b if i < j] if most == 2 else [])
    for x, a in enumerate(bins):
        for y, b in enumerate(bins):
            if x == y or fill[y] < fill[x] or fill[y] == capacity:
                continue
            for give in some(a, 2)[1:]:
                for take in some(b, 2 if len(give) == 1 else 1):
                    gain = int(n[list(give)].sum() - n[list(take)].sum()) if take else int(n[list(give)].sum())
                    assert not 0 < gain <= capacity - fill[y], (bins, give, take)


def test_search_empties_a_bin_that_best_fit_leaves():
    lengths = np.array([6, 6, 4, 4, 5, 5])
    assert len(packing.empty_bins([[0, 4], [1, 5], [2, 3]], lengths, 12)) == 3  # 30 of 36: nothing to win
    lengths = np.array([7, 6, 3, 2, 2])  # 20 in two bins of 10: exchange 3 for 2 and move
    assert len(packing.empty_bins([[0, 3], [1, 2], [4]], lengths, 10)) == 2


def test_packing_of_a_table_is_whole(spark):
    big = (1 << 53) + 1
    rows = [(i, prose(i, 30 + 7 * (i % 50))) for i in range(150)] + [(None, "no id"), (None, "no id"), (None, None), (big, prose(1, 60)), (8, LONG)]
    v = bpe.vocabulary(bpe.default_path())
    got = packing.best_fit_pack(table(spark, rows), group=40).collect()
    wanted = []
    for i, t in rows:
        ids = v.encode(t or "") + b"\x01\0\0\0"
        wanted += [(i, p, s, min(4096, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * s + 16384])) for p, s in enumerate(range(0, len(ids) // 4, 4096))]
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 4096) + 4


def test_pieces(spark):
    got = sorted(packing.best_fit_pack(table(spark, ODD), group=4).where("doc_id in (1, 2, 8)").collect(), key=lambda r: (r["doc_id"], r["piece"]))
    assert [(r["length"], r["ids_crc32"]) for r in got[:2]] == [(1, zlib.crc32(b"\x01\0\0\0"))] * 2
    ids = bpe.vocabulary(bpe.default_path()).encode(LONG) + b"\x01\0\0\0"
    assert [(r["start"], r["length"], r["ids_crc32"]) for r in got[2:]] == [(s, min(4096, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * s + 16384])) for s in range(0, len(ids) // 4, 4096)]


# ---- n-gram join -------------------------------------------------------------------------------------------------------


def changed(text, seed, n):
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    rows = []
    for family in range(12):
        base = prose(family, 150 + 10 * family)
        rows += [base, base] + [changed(base, 100 * family + k, k % 4) for k in range(family)]
    shared = prose(500, 60)
    rows += [f"{shared} {prose(600 + k, 100)}" for k in range(40)]
    return list(enumerate(rows))


def brute_links(rows, n=5, similarity=0.8):
    sets = {i: frozenset(shingles.shingle_set(t or "", n).tolist()) for i, t in rows}
    distinct = {s for s in sets.values() if s}
    links = {s: {o for o in distinct if o != s and len(s & o) >= similarity * len(s | o)} for s in distinct}
    seen: dict = {}
    for s in distinct:
        if s not in seen:
            group, stack = set(), [s]
            while stack:
                x = stack.pop()
                if x not in group:
                    group.add(x)
                    stack += links[x]
            least = min(i for i, t in sets.items() if t in group)
            seen.update(dict.fromkeys(group, least))
    return {i: (seen.get(s, i), len(links.get(s, ())), max(1, sum(o == s for o in sets.values())) if s else 1) for i, s in sets.items()}


@pytest.mark.parametrize(("limit", "block"), [(128, 1500), (3, 4)])
def test_join_finds_all_links(spark, monkeypatch, limit, block):
    monkeypatch.setattr(ngram_join, "LIMIT", limit)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies() + [(1000, "one two"), (1001, "one two"), (1002, None), (1003, "")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.ngram_join(table(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_rows_without_ids_and_with_repeated_ids_take_part(spark):
    base = prose(790, 100)
    rows = [(1, changed(base, 1, 1)), (None, base), (None, changed(base, 2, 1)), (3, ""), (3, changed(base, 3, 1)), (3, prose(791, 80)), (None, prose(792, 60)), (None, changed(prose(792, 60), 4, 1))]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.ngram_join(table(spark, rows)).collect()), key=str)
    wanted = [(1, 1, 3, True), (None, 1, 3, False), (None, 1, 3, False), (3, 3, 0, True), (3, 1, 3, False), (3, 3, 0, True), (None, None, 1, True), (None, None, 1, False)]
    assert got == sorted(wanted, key=str)


def test_a_large_bucket_with_a_repeated_empty_id(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIMIT", 4)
    base = prose(793, 120)
    rows = [(i, changed(base, 100 + i, 1)) for i in range(40)] + [(i, "") for i in range(40)]
    got = ngram_join.ngram_join(table(spark, rows)).collect()
    assert sorted(r["n_links"] for r in got) == [0] * 40 + [39] * 40 and sum(r["kept"] for r in got) == 41


@pytest.mark.parametrize("few", [0, 300_000])
def test_copies_without_an_id_and_hot_buckets_are_no_single_tasks(spark, monkeypatch, few):
    """A third of the rows is one text without an id, and most sets are near copies; with small buckets and blocks, and with
    the wanted texts shuffled or broadcast the result is that of brute force."""
    monkeypatch.setattr(scratch, "FEW_ROWS", few)
    monkeypatch.setattr(ngram_join, "LIMIT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    words = prose(41, 120).split()
    near = [(i, " ".join([*words[: 100 + i % 7], f"end{i}"])) for i in range(120)]
    rows = [(None, prose(5, 60))] * 80 + near + [(900 + i, prose(60 + i, 40)) for i in range(40)]
    sets = {frozenset(ngram_join.shingle_set(t, 5).tolist()) for _, t in rows}
    links = {s: sum(s != o and len(s & o) >= 0.8 * len(s | o) for o in sets) for s in sets}
    got = ngram_join.ngram_join(table(spark, rows).repartition(6)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 1 + 1 + 40 + 79  # rows that are the same in full all stay
    wanted = {i: links[frozenset(ngram_join.shingle_set(t, 5).tolist())] for i, t in rows}
    assert {r["doc_id"]: r["n_links"] for r in got} == wanted
    assert {r["class_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 120} == {0}


def test_long_sets_are_sampled_from_in_parts(monkeypatch):
    tokens, seeds = np.arange(1000, dtype=np.uint64), np.arange(7, dtype=np.uint64)
    whole = [x.tolist() for x in ngram_join.sampled(tokens, seeds, 50)]
    monkeypatch.setattr(ngram_join, "HASHES", 2000)
    assert [x.tolist() for x in ngram_join.sampled(tokens, seeds, 50)] == whole and 20 < np.mean([len(x) for x in whole]) < 80


def test_runs_grow_with_recall():
    assert ngram_join.runs_needed(0.8, 0.9) < ngram_join.runs_needed(0.8, 0.9999)


def test_runs_reach_the_recall_for_nested_sets():
    found = 1.0
    for rate in reversed(ngram_join.RATES):
        found = 1 - np.exp(-rate * 0.8 * found)
    assert 1 - (1 - found) ** ngram_join.runs_needed(0.8, 0.999) >= 0.999


def test_another_text_of_a_doc_id_has_no_paths(spark):
    fp = ngram_join.fingerprint(ngram_join.shingle_set(prose(770, 20), 5))
    large = spark.createDataFrame([(1, bytearray(fp))], "path long, fp binary")
    texts = spark.createDataFrame([(bytearray(fp), ""), (bytearray(fp), prose(770, 20))], "fp binary, text string")
    wanted = ngram_join.sampled(ngram_join.shingle_set(prose(770, 20), 5), np.array([1], np.uint64), 4.0)[0]
    got = [r["path"] for r in ngram_join.deeper(large, texts, 5, 4.0).collect()]
    assert len(wanted) and sorted(got) == sorted(wanted.view(np.int64).tolist())


@pytest.mark.parametrize("hot", [False, True])
def test_rows_of_buckets_are_moved_once(spark, monkeypatch, hot):
    plans = []
    monkeypatch.setattr(common, "written", lambda df, name: plans.append(df) or df)
    monkeypatch.setattr(common, "hot_list", lambda *_: [1] if hot else [])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(p, bytes([i])) for i, p in enumerate([1, 1, 1, 2, 3, 3, 4])], "path long, fp binary")
        got = sorted((r["path"], r["fp"][0], r["size"]) for r in ngram_join.sized(rows, "met").collect())
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (3, 4, 2), (3, 5, 2)]
    assert "Join" not in plan if not hot else "SortMergeJoin" not in plan


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---- substring dedup ---------------------------------------------------------------------------------------------------


def test_passages_are_found_exactly_and_fuzzily(spark):
    passage = prose(1, 60)
    fuzzy = changed(passage, 5, 4)
    rows = [(0, f"{prose(10, 80)} {passage} {prose(11, 80)}"), (1, f"{prose(12, 30)} {passage} {prose(13, 30)}"), (2, f"{prose(14, 30)} {fuzzy} {prose(15, 30)}"), (3, prose(16, 200)), (4, prose(1, 40)), (5, f"{prose(16, 200)}")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(30, 90)] and got[1]["kept_text"].split() == f"{prose(12, 30)} {prose(13, 30)}".split() and got[1]["ref_ids"] == [0]
    assert got[2]["n_removed"] >= 50
    assert got[0]["n_removed"] == got[3]["n_removed"] == got[4]["n_removed"] == 0
    assert got[5]["n_removed"] == 200 and got[5]["kept_text"] == ""


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique_by=lambda p: p[0]))
@settings(max_examples=100, deadline=None)
def test_the_best_chain_is_the_best(points):
    points = sorted(points)
    x, y = [p[0] for p in points], [p[1] for p in points]
    best: list[float] = []
    for i in range(len(x)):
        best.append(substring_dedup.K + max([0.0] + [best[j] - substring_dedup.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if y[j] < y[i]]))
    found = substring_dedup.chains(x, y)
    if found:
        c = found[0]
        score = substring_dedup.K * len(c) - substring_dedup.GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert score == pytest.approx(max(best))


def test_passages_with_unrelated_words_between_are_cut_apart(spark):
    sizes = [(100, 60), (100, 100), (100, 150), (51, 60)]
    rows = []
    for i, (n, gap) in enumerate(sizes):
        a, b = prose(700 + i, n), prose(710 + i, n)
        rows += [(10 * i, f"{a} {prose(720 + i, gap)} {b}"), (10 * i + 1, f"{prose(730 + i, 20)} {a} {prose(740 + i, gap)} {b} {prose(750 + i, 20)}")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    for i, (n, gap) in enumerate(sizes):
        assert not got[10 * i]["n_removed"]
        assert got[10 * i + 1]["kept_text"].split() == f"{prose(730 + i, 20)} {prose(740 + i, gap)} {prose(750 + i, 20)}".split()


def earlier_windows(rows, n=50):
    """Of each document the words that lie in a window of n words that an earlier document has too."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        mine = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        out[i] = {k + j for k, x in enumerate(mine) if x in seen for j in range(n)}
        seen.update(mine)
    return out


def removed_words(row):
    return {k for s in row["spans"] for k in range(s["start"], s["end"])}


def test_every_exact_passage_is_found_wherever_its_parts_come_first(spark):
    """Against brute force: corpora of fragments of several lengths, whose parts first occur here and there."""
    rows = []
    for seed, lengths, pool in ((1, (8, 64), 14), (2, (20, 49), 9), (3, (3, 30), 9), (4, (45, 120), 10), (5, (1, 6), 7)):
        rng = random.Random(seed)
        fragments = [prose(1000 * seed + k, rng.randint(*lengths)) for k in range(pool)]
        for i in range(60):
            parts = [rng.choice(fragments) if rng.random() < 0.75 else prose(5000 * seed + 100 * i + k, rng.randint(1, 40)) for k in range(rng.randint(1, 9 if seed < 5 else 40))]
            rows.append((100 * seed + i, " ".join(parts)))
    repeats = earlier_windows(rows)
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, rows).repartition(5)).collect()}
    missed = {i: sorted(repeats[i] - removed_words(got[i])) for i, _ in rows}
    assert all(sum(len(repeats[100 * seed + i]) for i in range(60)) > 100 for seed in range(1, 5)) and not any(missed.values()), missed
    similar = {i: len(removed_words(got[i]) - repeats[i]) for i, _ in rows}
    assert sum(similar.values()) <= 0.25 * sum(len(r["spans"]) * 50 for r in got.values())


def test_passages_of_parts_that_come_first_elsewhere(spark):
    a, b = prose(770, 40), prose(771, 40)
    rows = [(1, f"{prose(772, 30)} {a} {prose(773, 30)}"), (2, f"{prose(774, 30)} {b} {prose(775, 30)}")]
    rows += [(3, f"{prose(776, 30)} {a} {b} {prose(777, 30)}"), (4, f"{prose(778, 30)} {a} {b} {prose(779, 30)}")]
    # exact runs around words of which every fourth differs
    x, y, z = prose(780, 60), prose(781, 70).split(), prose(782, 60)
    other = [w if k % 4 else f"n{k}" for k, w in enumerate(y)]
    rows += [(5, f"{x} {' '.join(y)} {z}"), (6, f"{x} {' '.join(other)} {z}")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got[4]["kept_text"].split() == f"{prose(778, 30)} {prose(779, 30)}".split() and got[4]["ref_ids"] == [3]
    assert got[6]["n_removed"] == 190 and not any(got[i]["n_removed"] for i in (1, 2, 3, 5))


def test_fuzzy_passages_are_found(spark):
    rows, wanted = [], {}
    for i in range(40):
        passage = prose(3000 + i, 60 + 5 * i)
        words = passage.split()
        rng = random.Random(i)
        for _ in range(len(words) // 14):
            k = rng.randrange(len(words))
            words[k : k + 1] = [[], [f"new{k}"], [words[k], f"more{k}"]][rng.randrange(3)]
        rows += [(2 * i, f"{prose(3100 + i, 50)} {passage} {prose(3200 + i, 50)}"), (2 * i + 1, f"{prose(3300 + i, 50)} {' '.join(words)} {prose(3400 + i, 50)}")]
        wanted[2 * i + 1] = len(words)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, 80, 2))
    assert np.mean([abs(got[i] - n) <= 0.1 * n for i, n in wanted.items()]) >= 0.9


def test_fuzzy_passages_are_found_whose_parts_come_first_elsewhere(spark):
    """Parts of 13 words of each passage occur earlier, each in another document, and of some again in between."""
    rows, wanted = [], {}
    for i in range(40):
        passage = prose(3500 + i, 100).split()
        words = [f"new{k}" if k % 14 == 7 else w for k, w in enumerate(passage)]
        for n, k in enumerate(range(0, 100, 13)):
            rows.append((1000 * i + n, f"{prose(20_000 + 100 * i + n, 30)} {' '.join(passage[k : k + 13])} {prose(30_000 + 100 * i + n, 30)}"))
        rows += [(1000 * i + 500, f"{prose(3600 + i, 50)} {' '.join(passage)} {prose(3700 + i, 50)}"), (1000 * i + 501, f"{prose(3800 + i, 50)} {' '.join(words)} {prose(3900 + i, 50)}")]
        wanted[1000 * i + 501] = 100
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert not any(n for i, n in got.items() if i not in wanted)
    assert np.mean([abs(got[i] - n) <= 0.1 * n for i, n in wanted.items()]) >= 0.9


@pytest.mark.parametrize("between", [1, 110])
def test_fuzzy_passages_are_found_whose_parts_come_again_in_between(spark, between):
    """Parts of 13 words of each passage occur in other documents before the one that has it and again, in one or very many, after it."""
    rows, wanted = [], {}
    for i in range(12 if between == 1 else 3):
        passage = prose(6500 + i, 100).split()
        words = [f"new{k}" if k % 14 == 7 else w for k, w in enumerate(passage)]
        parts = [" ".join(passage[k : k + 13]) for k in range(0, 100, 13)]
        for n, part in enumerate(parts):
            rows.append((10_000 * i + n, f"{prose(40_000 + 100 * i + n, 30)} {part} {prose(50_000 + 100 * i + n, 30)}"))
            rows += [(10_000 * i + 600 + 10 * k + n, f"{prose(60_000 + 10_000 * i + 10 * k + n, 25)} {part} {prose(160_000 + 10_000 * i + 10 * k + n, 25)}") for k in range(between)]
        rows += [(10_000 * i + 500, f"{prose(6600 + i, 50)} {' '.join(passage)} {prose(6700 + i, 50)}"), (10_000 * i + 9000, f"{prose(6800 + i, 50)} {' '.join(words)} {prose(6900 + i, 50)}")]
        wanted[10_000 * i + 9000] = 100
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert not any(n for i, n in got.items() if i not in wanted)
    assert np.mean([abs(got[i] - n) <= 0.1 * n for i, n in wanted.items()]) >= 0.9


def test_pairs_of_a_text_that_goes_round_are_few():
    """Each word begins a seed, all of them equal: 400 words have 78 pairs a word, of which one in 23 words is enough."""
    at = np.arange(400)
    got = substring_dedup.pairs_of(np.zeros(400, np.int64), np.full(400, 7), at, at % 2 == 0, 23).to_pydict()
    assert [b >> substring_dedup.AT for b in got["both"]] == [-(-k // 2) * 2 for k in range(0, 377, 23)] and all(got["is_left"]) and len(set(got["pair"])) == 1
    far = substring_dedup.pairs_of(np.array([1, 1, 1, 2]), np.arange(4), np.array([0, 23, 101, 101]), np.ones(4, bool), 23).to_pydict()
    assert [(k, b >> substring_dedup.AT, b & 0xFFFFFFFF) for k, b in sorted(zip(far["key"], far["both"], strict=True))] == [(1, 0, 23), (1, 23, 101)]


def test_chains_of_two_texts_are_one_row_with_the_number_of_words(spark):
    """Two texts that meet in three places give one row, so texts that go round don't multiply the rows of what follows."""
    at = lambda a, b: (a << substring_dedup.AT) | b
    rows = [(9, 9, -1 - 400, 0), (8, 8, -1 - 70, 0)] + [(9, 1, at(x, x + 24), at(y, y + 24)) for x, y in ((0, 500), (150, 100), (300, 0))] + [(9, 2, at(0, 24), at(5, 29)), (8, 1, at(3, 27), at(3, 27))]
    got = substring_dedup.chained_pairs(spark.createDataFrame(rows, "key long, ref long, both long, ref_both long").repartition(1).sortWithinPartitions("key"), 28).collect()
    assert sorted((r["key"], r["ref"], r["words"], sorted(zip(r["xs"], r["ys"], strict=True))) for r in got) == [
        (8, 1, 70, [([3, 27], [3, 27])]),
        (9, 1, 400, [([0, 24], [500, 524]), ([150, 174], [100, 124]), ([300, 324], [0, 24])]),
        (9, 2, 400, [([0, 24], [5, 29])]),
    ]


@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 2), max_size=60), st.integers(0, 60), st.integers(0, 60), st.booleans())
@settings(max_examples=200, deadline=None)
def test_extensions_in_place_are_those_of_copies(a, b, x, y, slips):
    x, y = min(x, len(a)), min(y, len(b))
    assert substring_dedup.extension(a, b, slips=slips, x=x, y=y) == substring_dedup.extension(a[x:], b[y:], slips=slips)
    assert substring_dedup.extension(a, b, slips=slips, x=x - 1, y=y - 1, step=-1) == substring_dedup.extension(a[:x][::-1], b[:y][::-1], slips=slips)


def test_copies_need_no_seeds_and_go_whole_if_they_are_long_enough(spark):
    rows = [(1, prose(7000, 80)), (2, prose(7000, 80)), (3, prose(7001, 49)), (4, prose(7001, 49)), (None, prose(7000, 80)), (5, None), (6, "")]
    got = {r["doc_id"]: (r["n_removed"], r["ref_ids"], r["kept_text"]) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got == {1: (0, [], prose(7000, 80)), 2: (80, [1], ""), 3: (0, [], prose(7001, 49)), 4: (0, [], prose(7001, 49)), None: (80, [1], ""), 5: (0, [], ""), 6: (0, [], "")}
    texts = table(spark, rows).selectExpr("doc_id as key", "coalesce(text, '') as text").where("key is not null")
    assert sorted(map(tuple, substring_dedup.copies_of(texts).collect())) == [(2, 1), (4, 3), (6, 5)]


@given(st.lists(st.tuples(st.integers(-2, 3), st.integers(0, 4), st.integers(0, 6)), unique=True), st.integers(1, 5), st.booleans())
@settings(max_examples=150, deadline=None)
def test_first_rows_and_rows_before_are_those_of_the_whole_order(rows, size, own):
    rows = sorted(rows)
    wanted = []
    for i, (seed, key, place) in enumerate(rows):
        same = [r for r in rows if r[0] == seed]
        first, at = same[0], same.index(rows[i])
        if at or (own and place % 2 and len(same) > 1):
            before = same[at - 1] if at and same[at - 1][1] not in (first[1], key) else (seed, key, 0)
            wanted.append((key, place, first[1], first[2], before[1], before[2]))
    columns = [np.array([r[c] for r in rows], np.int64) for c in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], names=["seed", "key", "place"]) for i in range(0, len(rows) + 1, size)]
    got = [r for b in substring_dedup.of_ordered(iter(batches), own) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == wanted


def test_matches_with_the_row_before_add_nothing_where_a_chain_is_dense():
    """Many near copies of one text: each is chained with the first one only."""
    at = np.arange(0, 200, 6) << substring_dedup.AT
    key = np.repeat(np.arange(1, 6), len(at) + 1)
    place = np.tile([*at, -1 - 220], 5)
    ref_place = np.where(place < 0, 0, place)
    found = substring_dedup.found_in(key, place, np.zeros_like(key), ref_place, np.where(key > 1, key - 1, key), ref_place, 50, 28)
    assert sorted((k, r) for k, r, *_ in found) == [(k, 0) for k in range(1, 6)]
    assert substring_dedup.dense([0, 30, 60], [0, 30, 60], 50) == [] and substring_dedup.dense([0, 6, 12, 60, 100], [0, 6, 12, 60, 100], 50) == []


def test_copies_of_a_row_are_one_document(spark):
    rows = [(1, f"{prose(1, 60)} {prose(2, 60)}")] * 60 + [(2, f"{prose(3, 60)} {prose(2, 60)}")] * 60 + [(2, prose(4, 70)), (None, prose(2, 60)), ((1 << 63) - 1, prose(4, 70))]
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    removed = defaultdict(list)
    for r in got:
        removed[r["doc_id"]].append(r["n_removed"])
    assert removed[1] == [0] * 60 and sorted(removed[2]) == [0] + [60] * 60 and removed[None] == [60] and removed[(1 << 63) - 1] == [70]


def test_each_copy_of_an_earlier_passage_goes(spark):
    p = prose(760, 80)
    rows = [(0, f"{prose(761, 40)} {p} {prose(762, 40)}"), (1, f"{p} {prose(763, 200)} {p} {prose(764, 90)} {p}"), (2, f"{prose(765, 70)} {prose(765, 70)}")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got[1]["kept_text"].split() == f"{prose(763, 200)} {prose(764, 90)}".split()
    assert not got[0]["n_removed"] and not got[2]["n_removed"]


def test_chains_are_cut_where_it_takes(spark):
    del spark
    a, b, c, d = (list(range(k, k + 400)) for k in (0, 1000, 2000, 3000))

    def cut(x, y):
        at = [(i, y.index(v)) for i, v in enumerate(x) if v in y and x[i : i + 5] == y[y.index(v) : y.index(v) + 5] and len(x) - i >= 5]
        return substring_dedup.parts(x, y, [i for i, _ in at], [j for _, j in at], 50, 0.8)

    assert cut([*a[:100], *c[:30], *b[:100]], [*a[:100], *d[:30], *b[:100]]) == [(0, 100), (130, 230)]
    assert cut([*a[:100], *c[:300], *b[:60]], [*a[:100], *d[:200], *b[:60]]) == [(0, 100), (400, 460)]
    assert cut([*a[:40], *c[:10], *b[:40]], [*a[:40], *d[:10], *b[:40]]) == [(0, 90)]
    assert cut([*a[:30], *c[:30], *b[:30]], [*a[:30], *d[:30], *b[:30]]) == []
    long = [v if v % 4 else -v - 1 for v in a[100:300]]
    assert cut([*a[:100], *long, *a[300:]], a) == [(0, 400)]
    for x, y in ([a[:70], a[10:90]], [a[:70], [v if v % 7 else -1 for v in a[:80]]], [[1, 2, 3], [4, 5]]):
        assert substring_dedup.matched_in_rows(x, y) == substring_dedup.matched_words(x, y)


def test_chains_with_too_few_words_are_told_without_an_alignment(monkeypatch):
    """Two seeds and between them 60 words of which 10 agree, in another order: 20 of 70 words can't be a passage."""

    def never(*_):
        raise AssertionError("aligned")

    monkeypatch.setattr(substring_dedup, "matched_words", never)
    monkeypatch.setattr(substring_dedup, "matched_in_rows", never)
    both, own, others = list(range(10)), list(range(100, 150)), list(range(200, 250))
    x, y = [*range(300, 305), *both, *own, *range(400, 405)], [*range(300, 305), *others, *both[::-1], *range(400, 405)]
    assert substring_dedup.parts(x, y, [0, 65], [0, 65], 50, 0.8) == []


def test_chains_of_two_texts_share_the_texts(spark):
    """A passage comes back in three places of a later text: one row for the two texts, and each place is found once."""
    p, q = prose(770, 60), prose(771, 60)
    texts = [(0, f"{p} {q}"), (1, f"{p} {prose(772, 30)} {q} {prose(773, 30)} {p}")]
    starts = {0: [(0, 60), (60, 120)], 1: [(0, 60), (90, 150), (180, 240)]}
    at = [(b, r) for b, r in zip((0, 90, 180), (0, 60, 0), strict=True)] * 2  # each chain twice
    found = [(1, 0, 240, list(range(b, b + 56, 5)), list(range(r, r + 56, 5))) for b, r in at]
    chains = common.written(spark.createDataFrame(found, substring_dedup.FOUND), "chains")
    got = substring_dedup.aligned(chains, spark.createDataFrame(texts, "key long, text string"), 50, 0.8).collect()
    assert sorted((r["start"], r["end"]) for r in got) == starts[1]


def test_texts_are_given_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), spark.range(0, 4000, 1, 1).mapInArrow(sizes, "n long")
    most = lambda df: max(r["n"] for r in df.collect())
    assert most(common.written(rows, "sizes")) > common.BATCH_ROWS == most(common.written_in_small_batches(rows, "sizes"))
    assert spark.conf.get(key) == before


def test_cut_and_edits():
    assert substring_dedup.cut("a  b c\nd e", [(1, 3)]) == "a  d e"
    assert substring_dedup.matched_words([1, 2, 3, 4], [1, 9, 3, 4]) == 3
    assert substring_dedup.extension([1, 2, 9, 3, 4, 5], [1, 2, 8, 3, 4, 5]) == (6, 6, 5)
    assert substring_dedup.extension([*range(9), *range(20, 40)], [*range(9), 90, *range(20, 40)]) == (9, 9, 9)
    assert substring_dedup.extension([*range(9), *range(20, 40)], [*range(9), 90, *range(20, 40)], slips=True) == (29, 30, 29)
    assert substring_dedup.extension([1, 2, 3, 7, 8], [1, 2, 3, 4], slips=True) == (3, 3, 3)


# ---- suffixes ----------------------------------------------------------------------------------------------------------


def test_each_window_is_told_at_one_anchor():
    """Also where k-grams repeat within a window, and at both ends of a text."""
    rng = np.random.default_rng(5)
    for data in (rng.integers(0, 255, 1500).astype(np.uint8), np.tile(rng.integers(97, 122, 40), 30).astype(np.uint8), np.frombuffer(b"a" * 400, np.uint8), rng.integers(0, 255, 100).astype(np.uint8)):
        at, _ = suffix_dedup.anchors(data)
        rows = suffix_dedup.suffixes(data, at)
        spans = suffix_dedup.led_windows(rows, at, np.full(len(at), len(data)))
        told = [w for row, pos, i, j in zip(rows, at.tolist(), *(s.tolist() for s in spans), strict=True) for w in suffix_dedup.window_digests(row.tobytes(), 7, pos, i, j)]
        assert sorted(start for _, _, start in told) == list(range(len(data) - suffix_dedup.LENGTH + 1))
        assert all(d == hashlib.blake2b(data[s : s + 100].tobytes(), digest_size=suffix_dedup.DIGEST).digest() and k == 7 for d, k, s in told)


def brute_bytes(rows):
    first, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in first:
                covered[s : s + 100] = True
            first.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out[i] = (len(b), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [None, 2000, 1])
def test_suffixes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SHARE", 300)
    monkeypatch.setattr(suffix_dedup, "FAN", 3)
    if hot:  # k-grams that three places have are dealt by their windows, named in a list or in a table
        monkeypatch.setattr(suffix_dedup, "GROUP", 2)
        monkeypatch.setattr(common, "HOT", hot)
    base = prose(7, 400)
    rows = [(0, base), (1, base[300:900] + prose(8, 50) + base[:250]), (2, "abc " * 120), (3, "xx" + "abc " * 90), (4, base[:99]), (5, base[:100]), (6, None), (7, ""), (8, base), (9, changed(base, 3, 30)), (10, "é" * 130), (11, "z" + "é" * 90 + "\x00" * 5), (12, base[1000:1100] * 3)]
    rows += [(20 + k, f"{prose(900 + k, 20)} {base[500:760]} {prose(950 + k, 20)}") for k in range(30)]
    d = table(spark, rows).repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(d).collect()}
    assert got == brute_bytes(rows)


@given(st.lists(st.lists(st.text(alphabet="ab", min_size=0, max_size=6), max_size=8), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_loser_tree_merges_and_knows_shared_prefixes(runs):
    def coded(strings):
        last = b""
        for i, s in enumerate(sorted(x.encode().ljust(suffix_dedup.WIDTH, b"\xff") for x in strings)):
            shared = next((k for k in range(suffix_dedup.WIDTH) if not i or s[k] != last[k]), suffix_dedup.WIDTH)
            yield suffix_dedup.Suffix(shared if i else 0, s, i, 0)
            last = s

    got = list(suffix_dedup.merged([coded(r) for r in runs]))
    strings = [s.string for s in got]
    assert strings == sorted(x.encode().ljust(suffix_dedup.WIDTH, b"\xff") for r in runs for x in r)
    for a, b in zip(got, got[1:]):
        assert b.shared == next((k for k in range(suffix_dedup.WIDTH) if a.string[k] != b.string[k]), suffix_dedup.WIDTH)


# ---- rules, classifiers ------------------------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@given(st.text(alphabet="ab #|\n\t\x0b\x1c\xa0\u2003é", max_size=80))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    assert quality_rules.base_counts(text, quality_rules.words_of(text)) == brute_base(text)


def test_divergence_of_the_same_and_of_other_histograms():
    a, b = np.array([1, 1, 0]), np.array([0, 0, 5])
    assert quality_rules.js_distances(np.stack([a, b, 0 * b]), 2 * a).tolist() == [0, 1, 1]
    assert quality_rules.js_distances(np.stack([a]), 0 * b).tolist() == [1]


def test_documents_of_languages_without_a_reference_are_not_judged(spark):
    greek = "".join(chr(0x3B1 + ord(c) - ord("a")) if c != " " else c for c in prose(77, 90))
    rows = [(i, prose(i, 300), "en") for i in range(300)] + [(900, greek, "el"), (901, greek, "en"), (902, "x" * 40 + " " + prose(5, 80), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).where("doc_id >= 900").collect()}
    assert kept == {900: True, 901: False, 902: True}


def test_long_words_are_counted_each_for_itself():
    assert quality_rules.normal("a" * 30) != quality_rules.normal("b" * 30) and quality_rules.normal("(Word)") == "word"


@needs_data
def test_rules_keep_prose_and_drop_junk(spark):
    rows = quality_rules.quality_rules(llm.table(spark, str(DATA), "documents")).join(llm.table(spark, str(DATA), "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [[r["kept"] for r in rows if r["quality"] == q] for q in (1, 0)]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


@pytest.mark.parametrize(("text", "n"), [("you Idiot!", 1), ("1d10t", 1), ("іdіоt", 1), ("ＩＤＩＯＴ", 1), ("idiots", 0), ("put it in the trash can", 0), ("trash", 1), ("", 0)])
def test_folding_and_exceptions(text, n):
    assert len(toxicity.Lexicon().hits(text)) == n


def test_many_exceptions_take_no_square_of_time():
    assert len(toxicity.Lexicon().hits("trash can stupid " * 60_000)) == 60_000


@pytest.mark.parametrize(
    ("text", "n"),
    [("knot stupid", 1), ("not stupid", 0), ("not stupid stupid", 1), ("a class clown, a clown", 1), ("trash candidate", 1), ("you trash canine", 1), ("trash cans", 0), ("a fire retard.", 0), ("fire retardant", 0)],
)
def test_exception_phrases_begin_and_end_with_a_word(text, n):
    assert len(toxicity.Lexicon().hits(text)) == n


def test_words_are_learned_without_the_signs_around_them():
    assert {"worthless", "idiot", "trash", "wort*"} <= toxicity.shares("Worthless! (1d10t) +tra$h+").keys() and "worthlessi" not in toxicity.shares("worthless!")


def test_training_rows_are_bounded_and_the_same(spark):
    docs = table(spark, [(i % 8, prose(i, 5)) for i in range(400)])
    labels = spark.createDataFrame([(i, k) for i in range(8) for k in (0, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", 10, 1000)
    free = [i for i in range(8) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(rows) == len(free) and {y for _, y in rows} == {1}
    assert rows == toxicity.training_rows(docs.repartition(7), labels.repartition(3), "toxic", 10, 1000)
    assert len(toxicity.training_rows(docs, labels, "toxic", 2, 1000)) == 2
    size = max(len(text.encode()) for text, _ in rows)
    few = toxicity.training_rows(docs, labels, "toxic", 10, 1000, most_bytes=3 * size)
    assert 2 <= len(few) <= 4 and set(few) <= set(rows)
    assert toxicity.training_rows(docs, labels, "toxic", 10, 1000, most_bytes=1) == []


def test_stems_that_clean_texts_have_now_and_then_are_learned():
    """Half of the clean texts have a form of the stem once, toxic ones in each fiftieth word; the ends vary."""
    forms = lambda i, n: " ".join(f"grumb{'abcdefghijklmnop'[(i * 7 + k) % 16]}l" for k in range(n))
    rows = [(f"{prose(i, 300)} {forms(i, 6) if i % 8 == 0 else forms(i, 1) if i % 2 else ''}", int(i % 8 == 0)) for i in range(480)]
    lexicon = toxicity.lexicon_of(rows[:320])
    found = [lexicon.score(lexicon.features(text)) >= 0.7 for text, _ in rows[320:]]
    assert found == [y == 1 for _, y in rows[320:]]


LARGER = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not LARGER.exists(), reason="no test data")
def test_held_out_toxic_documents_are_found(spark):
    """Of the labelled rows that are missed, nearly all hold no word of any toxic text: they are junk under a toxic label, which no
    lexicon can find. AUC is thus judged over the others."""
    docs, labels = (llm.table(spark, str(LARGER), n) for n in ("documents", "labels"))
    lexicon = toxicity.fit_lexicon(docs, labels)
    rows = toxicity.score_toxicity(docs, lexicon).join(labels.where("toxic is not null"), "doc_id").where(common.held_out("doc_id")).collect()
    bad, good = [[r for r in rows if r["toxic"] == y] for y in (1, 0)]
    assert np.mean([r["predicted"] for r in bad]) >= 0.9 and np.mean([r["predicted"] for r in good]) < 0.005
    told = [r["score"] for r in bad if r["n_hits"]]
    assert len(told) >= 0.93 * len(bad)
    clean = np.sort([r["score"] for r in good])
    auc = np.mean((np.searchsorted(clean, told) + np.searchsorted(clean, told, "right")) / 2 / len(clean))
    assert auc > 0.99


def test_lexicon_is_learned_from_rows_that_are_not_held_out(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = [(i, f"{prose(i, 40)} {'zorgblat' + 'xyz'[i % 3] if i % 4 == 0 else 'plain'} {'heldword' if held(i) and i % 4 == 0 else ''} {prose(i + 999, 40)}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit_lexicon(table(spark, rows), labels)
    assert any(t.startswith("zorg") for t in lexicon.weights) and "heldword" not in lexicon.weights
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table(spark, rows), lexicon).collect()}
    assert np.mean([scored[i] == (i % 4 == 0) for i, _ in rows if held(i)]) > 0.95
    assert toxicity.without_toxic(table(spark, rows), lexicon).count() == sum(v == 0 for v in scored.values())


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(0)
    tables = rng.normal(size=(quality_classifier.TAPS, 256, quality_classifier.FILTERS)).astype(np.float32)
    text = bytes(rng.integers(1, 255, 40_000, dtype=np.uint8))
    data = np.frombuffer(text + b"\0" * quality_classifier.TAPS, np.uint8)
    direct = sum(tables[k][data[k : len(text) + k]] for k in range(quality_classifier.TAPS))
    blocks = quality_classifier.block_maxima(tables, text)
    assert len(blocks) == -(-len(text) // quality_classifier.BLOCK) and np.allclose(blocks.max(axis=0), direct.max(axis=0), atol=1e-4)


def test_network_learns_and_scores_held_out_rows(spark):
    rows = [(i, prose(i, 120) if i % 2 else re.sub(" ", "*** $$$ ", prose(i, 120))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    network = quality_classifier.fit_network(table(spark, rows), labels)
    out = {r["doc_id"]: r for r in quality_classifier.score_quality(table(spark, rows), network).collect()}
    assert np.mean([out[i]["predicted"] == i % 2 for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert quality_classifier.fit_network(table(spark, rows), labels.where("quality = 1")).score("x") == 0.5


# ---- queries -----------------------------------------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(llm.QUERIES[name](spark, str(DATA)), llm.ORACLES[name], connection())


@needs_data
def test_native_queries_run_no_python(spark):
    for name in ("op2_chat_windows", "op10_exact_dedup"):
        plan = llm.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_tables_kept_by_key_are_joined_where_they_are(spark):
    rows = spark.range(1000).selectExpr("id as fp", "cast(id as string) as text")
    kept, dropped = common.written_by_key(rows, "fp", "texts")
    joined = spark.range(0, 1000, 3).selectExpr("id as fp").hint("merge").join(kept, "fp")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    assert sorted(r["text"] for r in joined.collect()) == sorted(str(i) for i in range(0, 1000, 3))
    dropped()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmere_")]


def test_hot_windows_of_a_batch_are_told_once_and_the_others_covered(spark):
    """Three texts share 150 bytes around which they differ: each window is there once by its digest, all else as spans."""
    shared = prose(9100, 60)[:150]
    texts = {1: f"{prose(9101, 20)} {shared} {prose(9102, 20)}", 2: f"{prose(9103, 20)} {shared} {prose(9104, 20)}", 3: f"{prose(9103, 20)} {shared} {prose(9105, 20)}"}
    rows = [(k, t, suffix_dedup.anchors(suffix_dedup.as_bytes(t))[0].tolist()) for k, t in texts.items()]
    got = suffix_dedup.hot_windows(spark.createDataFrame(rows, "key long, text string, at array<int>").coalesce(1)).collect()
    told = {(r["key"], r["start"]) for r in got if r["digest"]}
    gone = {(r["key"], i) for r in got if not r["digest"] for i in range(r["start"], r["end"] - suffix_dedup.LENGTH + 1)}
    first: dict[str, tuple[int, int]] = {}
    for k, t in texts.items():
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (k, i))
    assert set(first.values()) <= told and len(told) == sum(1 for r in got if r["digest"]) == len({r["digest"] for r in got if r["digest"]})
    assert {(k, i) for k, t in texts.items() for i in range(len(t) - 99)} - set(first.values()) == gone


def test_later_windows_of_a_large_group_without_a_join(spark):
    """A digest that every run has gives all its places but the first one, each read once."""
    rows = [(b"a", key, start) for key in range(300) for start in (0, 5)] + [(b"b", 1, 7), (b"c", 2, 1), (b"c", 2, 0)]
    later = suffix_dedup.later_windows(spark.createDataFrame(rows, "digest binary, key long, start int"))
    assert "Join" not in later._jdf.queryExecution().optimizedPlan().toString()
    wanted = sorted([(key, start, start + 100) for d, key, start in rows if d == b"a" and (key, start) != (0, 0)] + [(2, 1, 101)])
    assert sorted(tuple(r) for r in later.collect()) == wanted


@pytest.mark.parametrize("of", [lambda i: i, lambda i: i.to_bytes(8, "big")])
def test_lookup_tells_hot_keys_by_a_filter(spark, of):
    """Rows of very frequent keys, long or binary, and of null and rare ones, are looked up without a semi-join."""
    rows = [(of(1), i) for i in range(150)] + [(of(2 + i % 30), i) for i in range(60)] + [(None, 0), (of(99), 0)]
    kind = "binary" if isinstance(rows[0][0], bytes) else "long"
    table_ = common.written(spark.createDataFrame(rows, f"k {kind}, v long"), "rows")
    facts = common.written(spark.createDataFrame([(of(i), 7 * i) for i in range(40)], f"k {kind}, fact long"), "facts")
    hot = common.hot_list(table_, "k")
    assert len(hot) == 1
    found = common.lookup(table_, facts, "k", hot)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan
    got = sorted((bytes(k) if kind == "binary" else k, v, fact) for k, v, fact in found.collect())
    assert got == sorted((k, v, 7 * n) for (k, v) in rows if k is not None for n in range(40) if of(n) == k)
