"""Physical plans: filters and columns reach the scan, joins have keys, top-k doesn't sort everything."""

from __future__ import annotations

import re

import pytest

from loomwright.plans import registry

QUERIES = registry.queries()
#: Queries whose nested loop is against rows of a stated bound: one row or a top list.
BOUNDED = {"a07", "a08", "a09", "a11", "a17", "a23", "j17", "j22", "j28", "l04", "r02", "r05", "r07"}


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "f02_category")
    assert "EqualTo(p_type,PROMO)" in text
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>", text)


def test_roll_up_reads_only_its_columns(spark, sf_dir):
    text = plan(spark, sf_dir, "a06_category_counts")
    assert re.search(r"ReadSchema: struct<p_brand:string,p_type:string>", text) and "partial_count" in text


@pytest.mark.parametrize("name", ["f09_book_search", "l06_top_n", "r03_search"])
def test_top_k_is_not_a_full_sort(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["w02_top_per_book_category", "w04_max_member"])
def test_rank_filters_reach_the_window(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] in "fjw" and n.split("_")[0] not in BOUNDED))
def test_no_join_without_keys(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
