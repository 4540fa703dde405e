"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from itemspark.catalog import QUERIES, inputs
from itemspark.operators import choose

FOLDER = "/root/testdata/sf0.01"
LAZY = ["f1_counts_per_taker", "f2_scenario_scores", "f4_benchmark_means", "f5_factor_scores",
        "f6_missing_counts", "f16_subscores", "f20_difficulty_spread", "f24_factor_profiles",
        "c5_adaptive_threshold", "c8_large_scenarios", "c11_drop_columns_with_null", "d2_fill_mean",
        "e2_lookup_default", "e8_taker_item_grid", "i1_undersample", "i2_exact_split", "j19_cronbach_alpha",
        "j20_fit_indices", "j21_auc", "j22_auc_by_scenario", "j28_interpretability", "l2_item_skills"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_scans_read_only_the_needed_columns(spark):
    text = plan(QUERIES["f2_scenario_scores"](spark, FOLDER))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert "l_partkey:bigint,l_suppkey:bigint,l_returnflag:string" in schemas
    assert "p_partkey:bigint,p_type:string" in schemas


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["c1_membership_filter"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*p_type.*p_brand", text)


def test_top_k_is_trimmed_before_the_shuffle(spark):
    items = inputs.study(spark, FOLDER).items
    text = plan(choose.best_in_group(items, ["scenario"], [F.col("item")], 3))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_ungrouped_ranks_use_slices(spark):
    """The only window without a partition key sees one row per slice."""
    text = plan(QUERIES["g13_row_numbers"](spark, FOLDER))
    assert len(re.findall(r"Window \[sum\(_rows", text)) == 1 and "row_number" not in text
