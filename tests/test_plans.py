"""Shape of the plans: native text work, pushed filters, no single-task windows over raw rows."""

import re

import pytest
from pyspark.sql import functions as F

from scanmill.functions.rules import predicate
from scanmill.plans import load
from scanmill.sources.identity import identity_docs

QUERIES, _ = load()


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["extract_fields", "detect_processor_priority", "clean_name", "fraud_scoring", "text_features", "nationality_code", "detect_global_types"])
def test_text_work_is_native(spark, sf, name):
    p = plan(spark, sf, name)
    assert "Python" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "scan_log_source")
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,10.0)]" in p
    q = plan(spark, sf, "performance_metrics")
    assert re.search(r"ReadSchema: struct<value:double>", q)


@pytest.mark.parametrize("name", ["running_average", "failed_attempts_15m", "sliding_rate_count", "recent_quality_trend", "percentiles_rank_by_type"])
def test_windows_over_rows_are_partitioned(spark, sf, name):
    assert "SinglePartition" not in plan(spark, sf, name)


def test_rank_limits_run_before_the_shuffle(spark, sf):
    assert plan(spark, sf, "recent_quality_trend").count("WindowGroupLimit") == 2
    assert plan(spark, sf, "last_n_turns").count("WindowGroupLimit") == 2


def test_extraction_has_no_shuffle_beyond_spreading(spark, sf):
    assert "hashpartitioning" not in plan(spark, sf, "extract_fields")


def test_identity_documents_are_rendered_by_all_cores(spark, sf):
    """The file of keys is one split; the texts made of them must not be one task."""
    docs = identity_docs(spark, sf)
    sizes = [n for n, in docs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 0.3 * sum(sizes)


def test_cheapest_detection_is_tried_first():
    few, many = ("any", ["x"]), ("any", [f"w{i}" for i in range(50)])
    sql = predicate(("and", many, few), "t", "low")
    assert sql.index("'x'") < sql.index("'w0'")
