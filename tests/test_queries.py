"""Every registered query against its check SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "source", "rank_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, con, sql) == []


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("stream_")])
def test_no_query_pairs_everything(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(entry.queries()["token_search_rank"](spark, FOLDER))
    assert "EqualTo(lang,en)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = _plan(entry.queries()["catalog_health"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan


@pytest.mark.parametrize("name", ["dedup_latest", "last_jobs", "key_latest_per_owner", "page_stored"])
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    assert "WindowGroupLimit" in plan and "Partial" in plan
