"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import SF_DIR

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = compare.database(SF_DIR)
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    problem = compare.check(database, df, ORACLES.get(name))
    assert problem is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert costly not in plan


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.columns == ["run", "accuracy", "f1_weighted", "n"]
    assert result.count() == 2


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "drop_null_target")
    assert "PushedFilters: [IsNotNull(quality)" in plan and "text" not in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(spark, sf_dir, "existence_left_join")


@pytest.mark.parametrize("name", ["sentence_bleu_zh", "max_over_references", "softmax_temperature", "frame_windows", "l2_normalize"])
def test_row_local_work_groups_nothing(spark, sf_dir, name):
    assert "Aggregate" not in plan_of(spark, sf_dir, name)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    for name in ("assign_ordinal_in_groups", "f1_weighted", "ema_over_batches", "kmeans_cosine", "session_step_machine"):
        rows = []
        for partitions in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows.append(compare.spark_rows(QUERIES[name](spark, sf_dir)))
        assert rows[0] == rows[1], name
