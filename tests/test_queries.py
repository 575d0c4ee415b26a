from __future__ import annotations

import pytest

import __spark_entry__ as entry
from quillmere.plans import queries as core
from tests.oracle import DATA, assert_same, connection, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, name):
    df = core.QUERIES[name](spark, str(DATA))
    if name in core.ORACLES:
        assert_same(df, core.ORACLES[name], connection())
    else:
        assert df.count() > 0


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["doc_duplicates", "change_router", "resolve_modules"])
def test_result_is_the_same_for_any_number_of_partitions(spark, name):
    def run(n: int) -> list:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            return sorted(map(str, core.QUERIES[name](spark, str(DATA)).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run(1) == run(7)


@needs_data
def test_line_operators_do_not_shuffle(spark):
    for name in ("search_context", "compact_log", "heading_index", "policy_index", "policy_check", "sections"):
        plan = core.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
