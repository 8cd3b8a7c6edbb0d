"""Report sinks.

Everything is written by Spark writers to a (shared) folder: the full report
and history as JSON lines, violations as Parquet partitioned by rule. Runs
are identified by ``run_id`` and partitioned by ``run_date``; writes append,
so re-running a failed job adds a new run instead of corrupting an old one.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.plans.suite import SuiteReport

#: Parts a rule's violations are dealt to before they are written.
SALTS = 64


def _run_columns(report: SuiteReport) -> list:
    return [
        F.lit(report.run_id).alias("run_id"),
        F.lit(report.timestamp).cast("timestamp").alias("run_timestamp"),
        F.lit(report.timestamp.date()).alias("run_date"),
        F.lit(report.connection_name).alias("connection"),
    ]


def report_frame(report: SuiteReport) -> DataFrame:
    """One row per rule result, tagged with the run."""
    return report.results.select(*_run_columns(report), "*",
                                 F.lit(report.duration_seconds).alias("run_duration_seconds"),
                                 F.lit(json.dumps(report.settings, default=str)).alias("settings"))


def write_report(report: SuiteReport, path: str, fmt: str = "json") -> None:
    """Append the full results of a run (JSON lines or Parquet), partitioned by run date."""
    report_frame(report).write.mode("append").partitionBy("run_date").format(fmt).save(path)


def summary_frame(report: SuiteReport) -> DataFrame:
    """One row - run facts, failures by severity, and the failed rules in
    severity order. One aggregate over the (one row per rule) results."""
    failed = ~F.col("passed")
    item = F.struct("severity_rank", "rule_name",
                    F.struct(F.col("rule_name").alias("name"), "severity", "table", "violation_count").alias("r"))
    row = report.results.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rules"),
        F.count_if(F.col("passed")).cast("bigint").alias("passed"),
        F.count_if(failed).cast("bigint").alias("failed"),
        F.struct(*[F.count_if(failed & (F.col("severity") == s)).cast("bigint").alias(s)
                   for s in ("critical", "high", "medium", "low")]).alias("failures_by_severity"),
        F.sort_array(F.collect_list(F.when(failed, item))).alias("__failed"),
    )
    return row.select(*_run_columns(report), F.lit(report.duration_seconds).alias("duration_seconds"),
                      "total_rules", "passed", "failed", "failures_by_severity",
                      F.col("failures_by_severity.critical").alias("critical_count"),
                      F.transform("__failed", lambda x: x["r"]).alias("failed_rules"))


def write_summary(report: SuiteReport, path: str) -> None:
    """Append the condensed run record as one JSON line."""
    summary_frame(report).coalesce(1).write.mode("append").partitionBy("run_date").json(path)


def history_frame(report: SuiteReport) -> DataFrame:
    """Compact line per run: timestamp, connection, total, passed, failed, critical, high, duration."""
    res = report.results
    return res.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if(F.col("passed")).cast("bigint").alias("passed"),
        F.count_if(~F.col("passed")).cast("bigint").alias("failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).cast("bigint").alias("critical"),
        F.count_if(~F.col("passed") & (F.col("severity") == "high")).cast("bigint").alias("high"),
    ).select(F.lit(report.timestamp).cast("timestamp").alias("timestamp"),
             F.lit(report.connection_name).alias("connection"), "*",
             F.lit(report.duration_seconds).alias("duration"), F.lit(report.run_id).alias("run_id"))


def append_history(report: SuiteReport, path: str) -> None:
    """Append one line to the history dataset."""
    history_frame(report).coalesce(1).write.mode("append").json(path)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.schema(
        "timestamp timestamp, connection string, total bigint, passed bigint, failed bigint, "
        "critical bigint, high bigint, duration double, run_id string").json(path)


def violations_frame(report: SuiteReport, rule_names: list[str] | None = None) -> DataFrame | None:
    """Every violating row of every (failed) rule, as ``rule_name, record`` where
    ``record`` is the row as JSON - one dataset for rules of different shapes."""
    passed = {r["rule_name"] for r in report.results.where("passed").select("rule_name").collect()}
    wanted = {n: o for n, o in report.outcomes.items() if n not in passed and (rule_names is None or n in rule_names)}
    parts, scans = [], defaultdict(dict)
    for name, out in wanted.items():
        if out.predicate is not None and out.source is not None:
            scans[id(out.source)][name] = out
        else:
            v = out.violations
            parts.append(v.select(F.lit(name).alias("rule_name"),
                                  F.to_json(F.struct(*[v[c] for c in v.columns])).alias("record")))
    for rules in scans.values():  # one scan for all row rules of a table
        source = next(iter(rules.values())).source
        found = [F.when(out.predicate, F.struct(F.lit(name).alias("rule_name"), F.to_json(F.struct(
            *[source[c] for c in source.columns], *[e.alias(c) for c, e in out.annotate.items()])).alias("record")))
            for name, out in rules.items()]
        parts.append(source.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.rule_name", "v.record"))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).select(*_run_columns(report), "rule_name", "record")


def write_violations(report: SuiteReport, path: str, rule_names: list[str] | None = None) -> None:
    """All violating rows (never capped), Parquet partitioned by run date and rule."""
    df = violations_frame(report, rule_names)
    if df is not None:
        # a rule's rows meet in SALTS partitions, so that not every task writes a file for every rule
        df = df.repartition("run_date", "rule_name", F.pmod(F.xxhash64("record"), F.lit(SALTS)))
        df.write.mode("append").partitionBy("run_date", "rule_name").parquet(path)


def write_rule_violations(report: SuiteReport, rule_name: str, path: str, fmt: str = "parquet") -> None:
    """S9, native shape: one rule's violations with their own columns."""
    report.outcomes[rule_name].violations.write.mode("append").format(fmt).save(path)
