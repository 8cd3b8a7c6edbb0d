"""Many row checks on one table, counted in a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.operators.base import Outcome


def fused_counts(source: DataFrame, checks: dict[str, Outcome]) -> DataFrame:
    """One row, one BIGINT column per check: ``agg(count_if(p1), ..., count_if(pN))``.

    Every check must be a row check over ``source`` (it carries a predicate).
    Catalyst evaluates all predicates in one whole-stage-codegen scan with a
    partial aggregate per task; the parquet reader only decodes the columns the
    predicates touch.
    """
    aggs = []
    for name, out in checks.items():
        if out.predicate is None:
            raise ValueError(f"check {name!r} is not a row predicate and cannot be fused")
        aggs.append(F.count_if(out.predicate).cast("bigint").alias(name))
    return source.agg(*aggs)


def tag_rows(df: DataFrame, predicates: dict[str, Column], column: str = "failed_rules") -> DataFrame:
    """Every row with the names of the predicates it fails, in rule order."""
    tags = [F.when(p, F.lit(name)) for name, p in predicates.items()]
    return df.withColumn(column, F.array_compact(F.array(*tags)))


def tag_failed_rules(source: DataFrame, checks: dict[str, Outcome], column: str = "failed_rules") -> DataFrame:
    """Every row with the names of the row checks it fails (empty array if none)."""
    return tag_rows(source, {name: out.predicate for name, out in checks.items()}, column)
