"""The flagship suite: a rule file over the test tables, run as one suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieve.plans.suite import SuiteReport, run_suite
from sieve.sources.tables import read_tables

FLAGSHIP_TABLES = ("lineitem", "orders", "customer", "part", "events")

FLAGSHIP_RULES: list[dict] = [
    {"name": "lineitem_required", "table": "lineitem", "type": "completeness", "severity": "critical",
     "columns": ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]},
    {"name": "lineitem_order_fk", "table": "lineitem", "type": "referential_integrity", "severity": "critical",
     "column": "l_orderkey", "reference_table": "orders", "reference_column": "o_orderkey"},
    {"name": "lineitem_quantity_range", "table": "lineitem", "type": "range", "severity": "medium",
     "column": "l_quantity", "min": 1, "max": 45},
    {"name": "lineitem_discount_range", "table": "lineitem", "type": "range", "severity": "low",
     "column": "l_discount", "min": 0, "max": 0.1},
    {"name": "lineitem_returnflag_format", "table": "lineitem", "type": "pattern", "severity": "low",
     "column": "l_returnflag", "pattern": "^[ANR]$"},
    {"name": "lineitem_shipdate_window", "table": "lineitem", "type": "date_range", "severity": "high",
     "column": "l_shipdate", "min": "1992-01-01", "max": "now", "as_of": "2001-06-30 00:00:00"},
    {"name": "lineitem_unique_line", "table": "lineitem", "type": "duplicates", "severity": "high",
     "columns": ["l_orderkey", "l_linenumber"]},
    {"name": "lineitem_price_outliers", "table": "lineitem", "type": "outliers", "severity": "medium",
     "column": "l_extendedprice", "method": "zscore", "threshold": 3},
    {"name": "orders_customer_fk", "table": "orders", "type": "referential_integrity", "severity": "critical",
     "column": "o_custkey", "reference_table": "customer", "reference_column": "c_custkey"},
    {"name": "orders_date_window", "table": "orders", "type": "date_range", "severity": "medium",
     "column": "o_orderdate", "min": "1996-01-01", "max": "2001-01-01"},
    {"name": "orders_priority_format", "table": "orders", "type": "pattern", "severity": "low",
     "column": "o_orderpriority", "pattern": "^[1-5]-"},
    {"name": "events_value_iqr", "table": "events", "type": "outliers", "severity": "low",
     "column": "value", "method": "iqr", "threshold": 1.5},
    {"name": "events_value_range", "table": "events", "type": "range", "severity": "medium",
     "column": "value", "min": 0, "max": 300},
    {"name": "customer_name_unique", "table": "customer", "type": "uniqueness", "severity": "high",
     "column": "c_name"},
    {"name": "part_brand_format", "table": "part", "type": "pattern", "severity": "low",
     "column": "p_brand", "pattern": "^Brand#[0-9]+$"},
    {"name": "customer_negative_balance", "type": "custom_sql", "severity": "low",
     "query": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0"},
]


def flagship_report(spark: SparkSession, sf_dir: str, settings: dict | None = None) -> SuiteReport:
    tables = read_tables(spark, sf_dir, FLAGSHIP_TABLES)
    return run_suite(spark, tables, FLAGSHIP_RULES, settings, connection_name="testdata")


def flagship_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_report(spark, sf_dir).results


# Per-rule violation counts in plain SQL, in rule order (the oracle of the suite).
FLAGSHIP_COUNTS_SQL = [
    ("lineitem_required", "completeness", "critical",
     "SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL OR l_suppkey IS NULL "
     "OR l_returnflag IS NULL OR l_returnflag = ''"),
    ("lineitem_order_fk", "referential_integrity", "critical",
     "SELECT count(*) FROM lineitem l WHERE l.l_orderkey IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"),
    ("lineitem_quantity_range", "range", "medium",
     "SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45"),
    ("lineitem_discount_range", "range", "low",
     "SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1"),
    ("lineitem_returnflag_format", "pattern", "low",
     "SELECT count(*) FROM lineitem WHERE NOT regexp_matches(l_returnflag, '^[ANR]$')"),
    ("lineitem_shipdate_window", "date_range", "high",
     "SELECT count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-01-01' "
     "OR l_shipdate > TIMESTAMP '2001-06-30 00:00:00'"),
    ("lineitem_unique_line", "duplicates", "high",
     "SELECT COALESCE(SUM(c - 1), 0) FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey, l_linenumber "
     "HAVING count(*) > 1)"),
    ("lineitem_price_outliers", "outliers", "medium",
     "SELECT count(*) FROM lineitem, (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM lineitem) st "
     "WHERE abs((l_extendedprice - st.m) / st.s) > 3"),
    ("orders_customer_fk", "referential_integrity", "critical",
     "SELECT count(*) FROM orders o WHERE o.o_custkey IS NOT NULL AND NOT EXISTS "
     "(SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)"),
    ("orders_date_window", "date_range", "medium",
     "SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-01-01'"),
    ("orders_priority_format", "pattern", "low",
     "SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')"),
    ("events_value_iqr", "outliers", "low",
     "SELECT count(*) FROM events, (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events) q "
     "WHERE value < q.q1 - 1.5 * (q.q3 - q.q1) OR value > q.q3 + 1.5 * (q.q3 - q.q1)"),
    ("events_value_range", "range", "medium",
     "SELECT count(*) FROM events WHERE value < 0 OR value > 300"),
    ("customer_name_unique", "uniqueness", "high",
     "SELECT COALESCE(SUM(c - 1), 0) FROM (SELECT count(*) c FROM customer WHERE c_name IS NOT NULL "
     "GROUP BY c_name HAVING count(*) > 1)"),
    ("part_brand_format", "pattern", "low",
     "SELECT count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]+$')"),
    ("customer_negative_balance", "custom_sql", "low",
     "SELECT count(*) FROM customer WHERE c_acctbal < 0"),
]

_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def flagship_oracle_sql() -> str:
    """The suite's six result columns as a UNION ALL of per-rule counts."""
    parts = []
    for name, kind, sev, sql in FLAGSHIP_COUNTS_SQL:
        parts.append(
            f"SELECT '{name}' AS rule_name, '{kind}' AS rule_type, '{sev}' AS severity, "
            f"CAST({_RANK[sev]} AS INTEGER) AS severity_rank, CAST(({sql}) AS BIGINT) = 0 AS passed, "
            f"CAST(({sql}) AS BIGINT) AS violation_count")
    return "\nUNION ALL\n".join(parts)
