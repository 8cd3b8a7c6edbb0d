"""Suite execution (E1-E7): rules in, one result row per rule out.

Planning:

* every rule compiles to an ``Outcome`` (lazy DataFrames);
* rules that are one predicate over one table (completeness, range, pattern,
  date range, cross field, and outliers once their statistics are known) are
  **fused**: one ``agg(count_if(p1), ..., count_if(pN))`` per table instead of
  N scans (E6). If a fused aggregate fails, its rules are re-run singly so a
  broken rule cannot take the others down (E4);
* other rules run their own one-row summary aggregate;
* the statistics of all outlier rules of a table are taken together, in one pass
  (``operators.column_stats``);
* only failing rules pay for a second, bounded job: a sample of at most
  ``sample_size`` violating rows, plus (referential) the first 20 orphan keys
  or (duplicates) the 10 largest groups and the first member rows by key.

Only counts and bounded samples reach the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.operators.base import Outcome
from sieve.operators.column_stats import column_statistics
from sieve.plans.fused import fused_counts
from sieve.plans.rules import SEVERITY_RANK, STATISTICS, compile_rule, validate_rules
from sieve.sources.tables import register_views

DEFAULT_SETTINGS = {"sample_size": 5, "stop_on_critical": False, "fuse": True,
                    "parallel_execution": True, "max_workers": 4}

RESULTS_SCHEMA = T.StructType([
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("severity_rank", T.IntegerType(), False),
    T.StructField("passed", T.BooleanType(), False),
    T.StructField("violation_count", T.LongType(), False),
    T.StructField("sample_records", T.ArrayType(T.StringType()), True),
    T.StructField("table", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("execution_time_ms", T.DoubleType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])


@dataclass
class SuiteReport:
    """What a run produces: the results DataFrame plus run-level facts."""

    results: DataFrame
    outcomes: dict[str, Outcome]
    connection_name: str
    timestamp: dt.datetime
    duration_seconds: float
    settings: dict
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)


def _meta(values: dict) -> dict[str, str]:
    out = {}
    for k, v in values.items():
        if v is None:
            continue
        out[str(k)] = v if isinstance(v, str) else json.dumps(v, default=str)
    return out


def _sample(out: Outcome, n: int) -> list[str]:
    if "sample" in out.extras:
        v = out.extras["sample"](n)
    else:
        v = out.violations
        if out.sample_order:
            v = v.orderBy(*out.sample_order)
        v = v.limit(n)
    rows = v.select(F.to_json(F.struct(*[v[c] for c in v.columns])).alias("j")).collect()
    return [r["j"] for r in rows]


def _result(rule: dict, passed: bool, count: int = 0, sample=None, error: str | None = None,
            elapsed_ms: float = 0.0, metadata: dict | None = None) -> dict:
    sev = str(rule["severity"]).lower()
    return {
        "rule_name": rule["name"],
        "rule_type": str(rule["type"]),
        "severity": sev,
        "severity_rank": SEVERITY_RANK[sev],
        "passed": bool(passed),
        "violation_count": int(count),
        "sample_records": list(sample or []),
        "table": rule.get("table", ""),
        "description": rule.get("description", ""),
        "error_message": error,
        "execution_time_ms": float(elapsed_ms),
        "metadata": _meta(metadata or {}),
    }


def _pmap(spark: SparkSession, settings: dict, fn, items: list, label) -> list:
    """Apply ``fn`` to every item, submitting the Spark jobs of independent
    items from separate driver threads so Spark runs them side by side (the
    cluster is shared by many small jobs instead of idling between them).
    Results come back in input order."""
    def run(item):
        spark.sparkContext.setJobDescription(f"sieve: {label(item)}")
        try:
            return fn(item)
        finally:
            spark.sparkContext.setJobDescription(None)

    workers = int(settings.get("max_workers", 4)) if settings.get("parallel_execution", True) else 1
    if workers <= 1 or len(items) <= 1:
        return [run(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as pool:
        return list(pool.map(run, items))


def _shared_statistics(spark: SparkSession, tables: dict, rules: list[dict], settings: dict) -> dict[tuple[str, str], dict]:
    """(table, column) -> statistics for the outlier rules that use moments or interpolated quartiles, one pass for each table.
    A table where that fails is left out: its rules take their own, and those that cannot fail alone (E4)."""
    wanted: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for rule in rules:
        if str(rule["type"]).lower() != "outliers" or rule.get("table") not in tables or rule.get("column") not in tables[rule["table"]].columns:
            continue
        method = str(rule.get("method") or "zscore").lower()
        if method == "zscore":
            wanted[rule["table"]][0].add(rule["column"])
        elif method in ("iqr", "iqr_cont") and rule.get("quartiles", "cont") == "cont":
            wanted[rule["table"]][1].add(rule["column"])

    def one(table):
        try:
            found = column_statistics(tables[table], sorted(wanted[table][0]), sorted(wanted[table][1]))
        except Exception:  # noqa: BLE001 - the rules find out one by one
            return {}
        return {(table, column): stats for column, stats in found.items()}

    found: dict[tuple[str, str], dict] = {}
    for part in _pmap(spark, settings, one, sorted(wanted), lambda t: f"statistics of {t}"):
        found |= part
    return found


def _evaluate(spark: SparkSession, tables: dict, rules: list[dict], settings: dict,
              outcomes: dict) -> dict[str, dict]:
    results: dict[str, dict] = {}
    statistics = _shared_statistics(spark, tables, rules, settings) if settings.get("fuse", True) else {}

    def compile_one(rule):
        t0 = time.perf_counter()
        known = statistics.get((rule.get("table"), rule.get("column")))
        try:
            return rule, compile_rule(spark, tables, {**rule, STATISTICS: known} if known else rule), (time.perf_counter() - t0) * 1e3, None
        except Exception as e:  # noqa: BLE001 - E4: one failed result, run continues
            return rule, None, (time.perf_counter() - t0) * 1e3, e

    compiled: dict[str, tuple[dict, Outcome, float]] = {}
    for rule, out, ms, err in _pmap(spark, settings, compile_one, rules, lambda r: r["name"]):
        if err is not None:
            results[rule["name"]] = _result(rule, False, error=f"rule cannot be built: {err}", elapsed_ms=ms)
        else:
            compiled[rule["name"]] = (rule, out, ms)

    counts: dict[str, tuple[int, dict, float]] = {}
    if settings.get("fuse", True):
        groups = defaultdict(list)
        for name, (_, out, _) in compiled.items():
            if out.predicate is not None and out.source is not None:
                groups[id(out.source)].append(name)

        def fused(names):
            src = compiled[names[0]][1].source
            t0 = time.perf_counter()
            try:  # E6: one scan for every row rule on this table
                row = fused_counts(src, {f"c{i}": compiled[n][1] for i, n in enumerate(names)}).first()
            except Exception:  # noqa: BLE001 - these rules are re-run singly below
                return names, None, 0.0
            return names, row, (time.perf_counter() - t0) * 1e3 / len(names)

        multi = [names for names in groups.values() if len(names) > 1]
        for names, row, share in _pmap(spark, settings, fused, multi, lambda ns: "fused " + ",".join(ns)):
            if row is not None:
                for i, n in enumerate(names):
                    counts[n] = (int(row[f"c{i}"] or 0), {"fused_scan": len(names)}, share)

    def finish(name):
        rule, out, t_compile = compiled[name]
        t0 = time.perf_counter()
        # intermediate results several jobs of this rule read (e.g. duplicate
        # groups): kept for the rule's jobs only; lost blocks are recomputed
        shared = out.extras.get("persist", []) if name not in counts else []
        for df in shared:
            df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if name in counts:
                count, extra, t_scan = counts[name]
            else:
                row = out.summary.first()
                extra = {k: v for k, v in (row.asDict() if row else {}).items() if k != "violation_count"}
                count = int(row["violation_count"] or 0) if row else 0
                t_scan = 0.0
            meta = dict(out.metadata, **extra)
            sample = []
            if count > 0:
                n = int(settings["sample_size"])
                if str(rule["type"]).lower() in ("duplicates", "uniqueness"):
                    n *= 2
                    meta["duplicate_groups"] = [r.asDict() for r in out.extras["groups"](10).collect()]
                if "orphan_values" in out.extras:
                    meta["orphan_values"] = [r["orphan_value"] for r in out.extras["orphan_values"](20).collect()]
                sample = _sample(out, n)
            elapsed = t_compile + t_scan + (time.perf_counter() - t0) * 1e3
            return name, _result(rule, count == 0, count, sample, None, elapsed, meta), out
        except Exception as e:  # noqa: BLE001
            return name, _result(rule, False, error=f"rule failed while running: {e}",
                                 elapsed_ms=t_compile + (time.perf_counter() - t0) * 1e3), None
        finally:
            for df in shared:
                df.unpersist()

    for name, res, out in _pmap(spark, settings, finish, list(compiled), lambda n: n):
        results[name] = res
        if out is not None:
            outcomes[name] = out
    return results


def run_suite(spark: SparkSession, tables: dict[str, DataFrame], rules: list[dict], settings: dict | None = None,
              severity_filter: list[str] | None = None, rule_names: list[str] | None = None,
              connection_name: str = "spark") -> SuiteReport:
    """Run ``rules`` against ``tables`` (name -> DataFrame).

    ``severity_filter`` keeps rules of the given severities (case-insensitive);
    ``rule_names`` keeps the named rules. With ``stop_on_critical`` the result
    ends at the first failed critical rule in list order (errors count as
    failed); critical rules are evaluated first so later rules can be skipped.
    """
    settings = {**DEFAULT_SETTINGS, **(settings or {})}
    start = time.perf_counter()
    ts = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rules = list(rules)
    if rule_names:
        keep = set(rule_names)
        rules = [r for r in rules if r.get("name") in keep]
    if severity_filter:
        wanted = {s.lower() for s in severity_filter}
        rules = [r for r in rules if str(r.get("severity", "")).lower() in wanted]
    validate_rules(rules)
    register_views(spark, tables)
    outcomes: dict[str, Outcome] = {}

    if settings.get("stop_on_critical"):
        crit = [r for r in rules if str(r["severity"]).lower() == "critical"]
        res = _evaluate(spark, tables, crit, settings, outcomes)
        cut = next((i for i, r in enumerate(rules) if r["name"] in res and not res[r["name"]]["passed"]), None)
        head = rules if cut is None else rules[:cut + 1]
        res.update(_evaluate(spark, tables, [r for r in head if r["name"] not in res], settings, outcomes))
        ordered = [res[r["name"]] for r in head]
    else:
        res = _evaluate(spark, tables, rules, settings, outcomes)
        ordered = [res[r["name"]] for r in rules]

    results = spark.createDataFrame(ordered, RESULTS_SCHEMA) if ordered else spark.createDataFrame([], RESULTS_SCHEMA)
    return SuiteReport(results=results, outcomes=outcomes, connection_name=connection_name, timestamp=ts,
                       duration_seconds=round(time.perf_counter() - start, 2), settings=settings)


def run_rule(spark: SparkSession, tables: dict[str, DataFrame], rule: dict, settings: dict | None = None) -> dict:
    """One rule directly; returns its result as a dict (E1 single rule)."""
    report = run_suite(spark, tables, [rule], settings)
    return report.results.first().asDict(recursive=True)
