from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quillmere.llm import common, toxicity
from tests.llm.test_llm import SCHEMA, changed, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    passage, base = prose(1, 70), prose(2, 120)
    rows = [(i, prose(100 + i, rng.randint(60, 200))) for i in range(60)]
    rows += [(100, f"{prose(300, 60)} you idiot {prose(301, 60)}"), (101, base), (102, base.upper()), (103, changed(base, 3, 2)), (104, f"{prose(302, 50)} {passage} {prose(303, 50)}"), (105, f"{prose(304, 50)} {passage} {prose(305, 50)}"), (106, passage), (107, None), (108, "")]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(rows), str(path)


def test_stages_do_what_they_say(spark, corpus):
    texts, path = corpus
    docs, left = common.table(spark, path, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = common.written(stage(spark, docs, path), name)
        assert docs.columns == columns
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(texts) - set(left["toxicity"]) == {100}
    assert set(left["toxicity"]) - set(left["exact_dedup"]) == {101, 107}
    assert set(left["exact_dedup"]) - set(left["ngram_jaccard_join"]) == {103}
    assert left["substring_dedup"][105].split() == f"{prose(304, 50)} {prose(305, 50)}".split()
    assert 106 not in left["substring_dedup"] and left["substring_dedup"][104] == texts[104]
    assert all(left["substring_dedup"][i] == texts[i] for i in range(60))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r["doc_id"] for r in packed.collect()} == set(left["substring_dedup"])


def test_run_is_the_stages_in_order(spark, corpus):
    _, path = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    got = corpus_pipeline.run(spark, path).groupBy("sequence_id").sum("length").collect()
    assert got and all(r[1] <= 4096 for r in got)


def test_stages_take_empty_tables_and_repeated_rows(spark, corpus):
    _, path = corpus
    docs = common.table(spark, path, "documents")
    odd = spark.createDataFrame([(1, "same", "en", "s", 4), (1, "same", "en", "s", 4), (None, "no id", None, None, None), (2, None, "en", "s", 0)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), path).count() == 0
    once = corpus_pipeline.drop_copies(spark, odd, path)
    assert once.count() == 3
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, once, path).count() == 3


def test_the_lexicon_without_labels_is_the_given_one():
    assert toxicity.Lexicon().weights["idiot"] == 1.0
