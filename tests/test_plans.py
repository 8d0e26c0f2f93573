"""What the plans must not contain, whatever the size of the tables."""

import os

import pytest

from kohorta.operators import longitudinal
from kohorta.plans.queries import QUERIES

SF = os.environ.get("KOHORTA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

RELATIONAL = [
    "flatten_visits", "sex_evidence", "map_codes", "prefix_match", "semi_join_index", "build_nested_records",
    "relational_to_records", "history_carry", "target_labels", "wide_pivot", "to_wide", "years_since_index", "timeline",
    "visit_validity", "cohort_classify", "cohort_attrition", "tableone_full", "tableone_merge", "scale_minmax",
]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInArrow"):
        assert node not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "cohort_classify")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "l_comment" not in text and "o_totalprice" not in text


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in plan(spark, "inner_enrich")


def test_literal_catalog_is_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan(spark, "map_codes")


def test_cohort_needs_no_window_or_self_join(spark):
    text = plan(spark, "cohort_select")
    assert "Window" not in text and "Join" not in text


def test_shifted_labels_read_the_diagnoses_once(spark, table, rows):
    plan = QUERIES["label_shift_union"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3
    dx = table([("a", 1, 4, "X"), ("a", 2, 5, "X"), ("a", 2, 5, "Y"), ("b", 3, None, "X"), (None, 4, 1, "X")], "p_id STRING, visit_idx INT, age INT, code STRING")
    name = longitudinal.LABEL_PREFIX + "X"
    want = [("a", 3, name), ("a", 4, name), ("a", 5, name), ("b", None, name), (None, 0, name), (None, 1, name)]
    assert rows(longitudinal.shifted_targets(dx, ["X"])) == want
