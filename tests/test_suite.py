"""Suite execution, report aggregations and sinks."""

import os
import tempfile

import pytest

from sieve.plans import report as G
from sieve.plans.flagship import FLAGSHIP_RULES, flagship_report
from sieve.plans.rules import RuleError
from sieve.plans.suite import run_suite
from sieve.sources import sinks

from conftest import SF_SMALL

RULES = [
    {"name": "email_required", "type": "completeness", "table": "customers", "columns": ["email"],
     "severity": "high"},
    {"name": "valid_customer", "type": "referential_integrity", "table": "orders", "column": "customer_id",
     "reference_table": "customers", "reference_column": "id", "severity": "critical"},
    {"name": "no_dup", "type": "duplicates", "table": "customers", "columns": ["name", "age"], "severity": "medium"},
    {"name": "age_range", "type": "range", "table": "customers", "column": "age", "min": 0, "max": 120,
     "severity": "medium"},
    {"name": "score_z", "type": "outliers", "table": "customers", "column": "score", "method": "zscore",
     "threshold": 2, "severity": "low"},
    {"name": "name_set", "type": "completeness", "table": "customers", "columns": ["name"], "severity": "low"},
]


def by_name(report):
    return {r["rule_name"]: r for r in report.results.collect()}


def test_suite_counts_and_fusion(spark, fixture_tables):
    rep = run_suite(spark, fixture_tables, RULES)
    res = by_name(rep)
    assert [r["rule_name"] for r in rep.results.collect()] == [r["name"] for r in RULES]
    assert {k: v["violation_count"] for k, v in res.items()} == {
        "email_required": 1, "valid_customer": 1, "no_dup": 1, "age_range": 1, "score_z": 1, "name_set": 0}
    assert res["name_set"]["passed"] and not res["email_required"]["passed"]
    # the four row rules on customers were counted by one scan
    assert res["email_required"]["metadata"]["fused_scan"] == "4"
    assert res["valid_customer"]["metadata"]["orphan_values"] == "[999]"
    assert len(res["no_dup"]["sample_records"]) == 2


def test_unfused_equals_fused(spark, fixture_tables):
    a = {k: v["violation_count"] for k, v in by_name(run_suite(spark, fixture_tables, RULES)).items()}
    b = {k: v["violation_count"] for k, v in
         by_name(run_suite(spark, fixture_tables, RULES, {"fuse": False})).items()}
    assert a == b


def test_error_isolation(spark, fixture_tables):
    bad = RULES + [
        {"name": "unknown_table", "type": "completeness", "table": "nowhere", "columns": ["x"], "severity": "low"},
        {"name": "unknown_column", "type": "range", "table": "customers", "column": "nope", "min": 1,
         "severity": "low"},
        {"name": "bad_sql", "type": "custom_sql", "query": "SELEC nonsense", "severity": "low"},
    ]
    res = by_name(run_suite(spark, fixture_tables, bad))
    for name in ("unknown_table", "unknown_column", "bad_sql"):
        assert res[name]["passed"] is False and res[name]["error_message"], name
    assert res["email_required"]["violation_count"] == 1


def test_rule_structure_errors_fail_fast(spark, fixture_tables):
    with pytest.raises(RuleError):
        run_suite(spark, fixture_tables, [{"name": "x", "type": "range"}])
    with pytest.raises(RuleError):
        run_suite(spark, fixture_tables, [{"name": "x", "type": "range", "severity": "urgent"}])


@pytest.mark.parametrize("rule", [
    {"type": "magic", "table": "customers"},
    {"type": "range", "table": "customers", "column": "age"},
    {"type": "range", "column": "age", "min": 1},
    {"type": "duplicates", "table": "customers", "columns": []},
    {"type": "custom_sql", "query": " "},
    {"type": "pattern", "table": "customers", "column": "name"},
    {"type": "inactive_parents", "table": "customers", "key": "id"},
])
def test_types_and_fields_fail_fast(spark, fixture_tables, rule):
    with pytest.raises(RuleError):
        run_suite(spark, fixture_tables, RULES + [{"name": "bad", "severity": "low", **rule}])


def test_register_check(spark, fixture_tables):
    from pyspark.sql import functions as F

    from sieve import register_check, rule_types
    from sieve.operators.base import row_check

    register_check("even_ids", lambda spark, tables, rule: row_check(tables[rule["table"]], F.col(rule["column"]) % 2 == 0),
                   required=("table", "column"))
    try:
        assert "even_ids" in rule_types()
        rule = {"name": "even", "type": "even_ids", "table": "customers", "column": "id", "severity": "low"}
        assert by_name(run_suite(spark, fixture_tables, [rule]))["even"]["violation_count"] == 3
        with pytest.raises(RuleError):
            run_suite(spark, fixture_tables, [{"name": "even", "type": "even_ids", "table": "customers", "severity": "low"}])
    finally:
        from sieve.plans import rules
        rules._REGISTRY.pop("even_ids"), rules._REQUIRED.pop("even_ids")


def test_severity_filter_and_names(spark, fixture_tables):
    rep = run_suite(spark, fixture_tables, RULES, severity_filter=["CRITICAL", "high"])
    assert [r["rule_name"] for r in rep.results.collect()] == ["email_required", "valid_customer"]
    rep = run_suite(spark, fixture_tables, RULES, severity_filter=["none"])
    assert rep.results.count() == 0
    rep = run_suite(spark, fixture_tables, RULES, rule_names=["age_range"])
    assert [r["rule_name"] for r in rep.results.collect()] == ["age_range"]


def test_stop_on_critical(spark, fixture_tables):
    rep = run_suite(spark, fixture_tables, RULES, {"stop_on_critical": True})
    assert [r["rule_name"] for r in rep.results.collect()] == ["email_required", "valid_customer"]


def test_report_aggregations(spark, fixture_tables):
    res = run_suite(spark, fixture_tables, RULES).results
    assert G.run_summary(res).first().asDict() == {"total_rules": 6, "passed": 1, "failed": 5}
    assert G.failures_by_severity(res).first().asDict() == {"critical": 1, "high": 1, "medium": 2, "low": 1}
    assert [r["rule_name"] for r in G.failed_rules(res).collect()] == [
        "valid_customer", "email_required", "age_range", "no_dup", "score_z"]
    assert G.critical_failures(res).count() == 1 and G.high_failures(res).count() == 1


def test_sinks_roundtrip(spark, fixture_tables):
    rep = run_suite(spark, fixture_tables, RULES)
    base = tempfile.mkdtemp(prefix="sieve-sinks-")
    sinks.write_report(rep, os.path.join(base, "report"))
    sinks.write_summary(rep, os.path.join(base, "summary"))
    sinks.append_history(rep, os.path.join(base, "history"))
    sinks.append_history(rep, os.path.join(base, "history"))
    sinks.write_violations(rep, os.path.join(base, "violations"))
    assert spark.read.json(os.path.join(base, "report")).count() == 6
    s = spark.read.json(os.path.join(base, "summary")).first()
    assert s["failed"] == 5 and s["critical_count"] == 1
    assert [r["name"] for r in s["failed_rules"]][:2] == ["valid_customer", "email_required"]
    hist = sinks.read_history(spark, os.path.join(base, "history"))
    assert hist.count() == 2
    trend = G.history_trend(hist).orderBy("timestamp", "run_id").collect()
    assert trend[1]["previous_failed"] == 5
    v = spark.read.parquet(os.path.join(base, "violations"))
    counts = {r["rule_name"]: r["count"] for r in v.groupBy("rule_name").count().collect()}
    # all violating rows, not samples (duplicates list both member rows)
    assert counts == {"email_required": 1, "valid_customer": 1, "no_dup": 2, "age_range": 1, "score_z": 1}


def test_flagship_runs_on_small_tables(spark):
    rep = flagship_report(spark, SF_SMALL)
    rows = rep.results.collect()
    assert len(rows) == len(FLAGSHIP_RULES)
    assert all(r["error_message"] is None for r in rows)


def test_scale_conf_sizes():
    from sieve.session import scale_conf
    big = scale_conf(100 << 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 512 << 20
    small = scale_conf(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 8
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 32 << 20


def test_runtime_error_inside_fused_scan_is_isolated(spark, fixture_tables):
    """A predicate that fails only at run time (ANSI cast of 'Alice' to a number) breaks the
    fused aggregate; its table's rules are re-run singly and only the broken one fails."""
    rules = RULES + [{"name": "name_as_number", "type": "range", "table": "customers", "column": "name",
                      "min": 0, "severity": "low"}]
    res = by_name(run_suite(spark, fixture_tables, rules))
    assert res["name_as_number"]["passed"] is False and res["name_as_number"]["error_message"]
    assert res["email_required"]["violation_count"] == 1 and res["age_range"]["violation_count"] == 1
    assert "fused_scan" not in res["email_required"]["metadata"]
