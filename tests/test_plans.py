"""The plans are the ones wanted: pruned scans, early limits, no Python where none is needed."""

import pytest

from kgspark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = registry.all_queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "scan_parquet")
    assert "GreaterThan(o_totalprice,400000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_top_k_is_cut_in_every_task(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "top_degree")
    assert "WindowGroupLimit" in plan_of(spark, "docs_top_k_per_source")
    assert "WindowGroupLimit" in plan_of(spark, "dedupe_columns")


@pytest.mark.parametrize("name", ["parse_records", "json_repair"])
def test_entities_and_brackets_go_through_arrow_only(spark, name):
    # the full table of entities and the bracket stack have no JVM expression
    plan = plan_of(spark, name)
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["order_by", "win_percent_rank", "genid_increment", "report_batches"])
def test_work_without_a_group_is_not_one_task(spark, name):
    plan = plan_of(spark, name)
    assert "Coalesce 1" not in plan
    # sums of blocks may meet in one task, for their running sums and for the total; rows may not
    assert plan.count("SinglePartition") <= 2


@pytest.mark.parametrize("name", ["chunk_tokens", "map_points", "page_text", "row_to_report"])
def test_text_work_needs_no_python_and_no_shuffle_by_key(spark, name):
    plan = plan_of(spark, name)
    assert "Python" not in plan and "InPandas" not in plan
    assert "hashpartitioning" not in plan


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(spark, "agg_multi_key")
    assert "partial_count" in plan and plan.count("Exchange") == 1
