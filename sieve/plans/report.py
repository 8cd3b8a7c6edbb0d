"""Report aggregations over suite results and over data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.plans.rules import SEVERITIES


def run_summary(results: DataFrame) -> DataFrame:
    """G1: total_rules, passed, failed."""
    return results.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_rules"),
        F.count_if(F.col("passed")).cast("bigint").alias("passed"),
        F.count_if(~F.col("passed")).cast("bigint").alias("failed"),
    )


def failures_by_severity(results: DataFrame) -> DataFrame:
    """One row, one zero-filled count per severity."""
    return results.agg(*[
        F.count_if(~F.col("passed") & (F.col("severity") == s)).cast("bigint").alias(s) for s in SEVERITIES])


def failed_rules(results: DataFrame) -> DataFrame:
    """Failed results, most severe first, then by name."""
    return results.filter(~F.col("passed")).orderBy("severity_rank", "rule_name")


def critical_failures(results: DataFrame) -> DataFrame:
    """G4."""
    return results.filter(~F.col("passed") & (F.col("severity") == "critical"))


def high_failures(results: DataFrame) -> DataFrame:
    """G4."""
    return results.filter(~F.col("passed") & (F.col("severity") == "high"))


def with_match_flag(df: DataFrame, column: str, parent: DataFrame, parent_column: str, flag: str,
                    **opts) -> DataFrame:
    """Add boolean ``flag``: the row's key is not an orphan - the hand rewrite of
    ``key NOT IN (subquery)`` inside a CASE, which Spark would plan as a
    broadcast nested-loop join. As there, a NULL key is not counted against the row."""
    from sieve.operators.referential import flag_orphans

    out = flag_orphans(df, column, parent, parent_column, "__orphan", **opts)
    return out.withColumn(flag, ~F.col("__orphan")).drop("__orphan")


def quality_score(table_name: str, df: DataFrame, issue: Column) -> DataFrame:
    """total_records, records_with_issues, quality_score DECIMAL(5,2) (NULL for an empty table)."""
    total = F.count(F.lit(1))
    bad = F.count_if(issue)
    score = F.when(total > 0, F.lit(100.0) - bad * F.lit(100.0) / F.greatest(total, F.lit(1))).cast("decimal(5,2)")
    return df.agg(F.lit(table_name).alias("table_name"), total.cast("bigint").alias("total_records"),
                  bad.cast("bigint").alias("records_with_issues"), score.alias("quality_score"))


def quality_scores(parts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """G5 for several tables (UNION ALL)."""
    return reduce(DataFrame.unionByName, [quality_score(n, d, c) for n, d, c in parts])


def quality_trend(df: DataFrame, ts_column: str, counts: dict[str, Column]) -> DataFrame:
    """Per calendar date - rows checked and one count per named condition, newest first."""
    day = F.to_date(F.col(ts_column)).alias("check_date")
    aggs = [F.count(F.lit(1)).cast("bigint").alias("records_checked")]
    aggs += [F.count_if(c).cast("bigint").alias(name) for name, c in counts.items()]
    return df.groupBy(day).agg(*aggs).orderBy(F.col("check_date").desc())


def history_trend(history: DataFrame, ts_column: str = "timestamp", key: str = "connection") -> DataFrame:
    """Run history with the change in failures since the previous run of the
    same connection. History holds one row per run, so each window partition is
    that connection's run list (small by construction)."""
    w = Window.partitionBy(key).orderBy(F.col(ts_column))
    prev = F.lag("failed").over(w)
    return history.select("*", prev.alias("previous_failed"), (F.col("failed") - prev).alias("failed_change"))
