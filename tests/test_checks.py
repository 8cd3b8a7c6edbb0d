"""Unit fixture tests: the reference's assertions plus the derived exact values."""

import pytest

from sieve.operators import completeness as C
from sieve.operators import custom_sql as Q
from sieve.operators import duplicates as D
from sieve.operators import outliers as O
from sieve.operators import ranges as N
from sieve.operators import referential as R
from sieve.plans.suite import run_rule
from sieve.sources.tables import register_views


def count(outcome):
    return outcome.summary.first()["violation_count"]


def test_completeness_detects_null(fixture_tables):
    out = C.completeness(fixture_tables["customers"], ["email"])
    assert count(out) == 1
    assert [r["name"] for r in out.violations.collect()] == ["Bob"]


def test_completeness_passes_when_complete(fixture_tables):
    assert count(C.completeness(fixture_tables["customers"], ["name"])) == 0


def test_incomplete_fields_annotation(fixture_tables):
    out = C.completeness(fixture_tables["customers"], ["email", "age"])
    got = {r["name"]: r["incomplete_fields"] for r in out.violations.collect()}
    assert got == {"Bob": "email", "Charlie": "age"}


def test_referential_orphans(fixture_tables):
    out = R.orphans(fixture_tables["orders"], "customer_id", fixture_tables["customers"], "id")
    assert count(out) == 1
    assert [r["orphan_value"] for r in out.extras["orphan_values"](20).collect()] == [999]


def test_duplicates_exact_counts(fixture_tables):
    out = D.duplicates(fixture_tables["customers"], ["name", "age"])
    row = out.summary.first()
    assert (row["violation_count"], row["group_count"], row["member_rows"]) == (1, 1, 2)
    members = out.violations.collect()
    assert sorted(r["id"] for r in members) == [1, 4]
    assert all(r["group_size"] == 2 for r in members)


def test_range_out_of_bounds(fixture_tables):
    out = N.value_range(fixture_tables["customers"], "age", 0, 120)
    assert count(out) == 1
    assert out.violations.first()["name"] == "Eve"


def test_zscore_threshold_2(fixture_tables):
    out = O.zscore(fixture_tables["customers"], "score", 2)
    assert count(out) == 1
    row = out.violations.first()
    assert row["name"] == "Frank" and row["zscore"] == pytest.approx(2.0410, abs=1e-4)
    assert out.metadata["mean"] == pytest.approx(239.5833, abs=1e-4)
    assert out.metadata["std_dev"] == pytest.approx(372.0826, abs=1e-4)


def test_zscore_threshold_3_cannot_fire_on_six_rows(fixture_tables):
    assert count(O.zscore(fixture_tables["customers"], "score", 3)) == 0


def test_iqr_interpolated(fixture_tables):
    out = O.iqr(fixture_tables["customers"], "score", 1.5)
    m = out.metadata
    assert (m["q1"], m["median"], m["q3"]) == (86.125, 90.0, 94.25)
    assert (m["lower_bound"], m["upper_bound"]) == (73.9375, 106.4375)
    assert [r["name"] for r in out.violations.collect()] == ["Frank"]


def test_iqr_rank(fixture_tables):
    out = O.iqr(fixture_tables["customers"], "score", 1.5, quartiles="rank")
    m = out.metadata
    assert (m["q1"], m["median"], m["q3"]) == (85.5, 92.0, 95.0)
    assert (m["lower_bound"], m["upper_bound"]) == (71.25, 109.25)
    assert count(out) == 1


def test_custom_sql_finds_violations(spark, fixture_tables):
    register_views(spark, fixture_tables)
    assert count(Q.custom_sql(spark, "SELECT * FROM customers WHERE age > 100")) == 1


def test_custom_sql_passes(spark, fixture_tables):
    register_views(spark, fixture_tables)
    assert count(Q.custom_sql(spark, "SELECT * FROM customers WHERE name = 'NonExistent'")) == 0


def test_count_query_lookup_order(spark, fixture_tables):
    register_views(spark, fixture_tables)
    out = Q.custom_sql(spark, "SELECT * FROM customers WHERE age > 100",
                       count_query="SELECT 7 AS total, 3 AS other")
    assert count(out) == 7
    out = Q.custom_sql(spark, "SELECT 1", count_query="SELECT 4 AS n")
    assert count(out) == 4


def test_run_rule_result_shape(spark, fixture_tables):
    res = run_rule(spark, fixture_tables, {"name": "email_required", "type": "completeness", "table": "customers",
                                           "columns": ["email"], "severity": "HIGH"})
    assert res["passed"] is False and res["violation_count"] == 1 and res["severity"] == "high"
    assert len(res["sample_records"]) == 1 and '"Bob"' in res["sample_records"][0]
    assert res["metadata"]["columns_checked"] == '["email"]'
