"""Physical plans: what reaches the scan, what is not shuffled, what runs in generated code."""

from __future__ import annotations

import re

import pytest

from tessera.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scan_one_column", "scan_column_subset", "point_lookup", "filter_compare", "project_cols", "vec_view"])
def test_no_exchange(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_pruning(spark):
    assert re.search(r"ReadSchema: struct<c_acctbal:double>", plan(spark, "scan_one_column"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderkey,7\)", plan(spark, "point_lookup"))
    assert plan(spark, "named_bodied_lookup").count("EqualTo(") == 2


def test_no_python_and_no_cartesian(spark):
    for name in plans.queries():
        if name not in ("cyk_parse", "cyk_parse_fixed"):
            text = plan(spark, name)
            assert not re.search(r"PythonUDF|ArrowEval|MapIn|CartesianProduct|BroadcastNestedLoop", text), name


def test_numbered_rows_share_their_exchange(spark):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(spark, "merge_join_zip").count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_sides_are_not_shuffled_to(spark):
    """A few nations meet all moves: no exchange by their 25 keys."""
    for name in ("default_amend_chain", "natural_join_hash"):
        assert "nationkey" not in " ".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, name))), name


def test_large_sides_keep_their_hint(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "ShuffledHashJoin" in plan(spark, "natural_join_hash") and "SortMergeJoin" in plan(spark, "natural_join_merge")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_repeated_keys_are_dealt(spark):
    """A customer file of one block gives its pairs from many tasks."""
    from pyspark.sql import functions as F

    for name in ("natural_join_hash", "natural_join_overlap"):
        parts = plans.queries()[name](spark, SF).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 8, name
