"""Range, date-range, future-date and cross-field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions import predicates as P
from sieve.operators.base import Outcome, row_check


def value_range(df: DataFrame, column: str, min_value=None, max_value=None,
                inclusive: bool = True) -> Outcome:
    """Non-NULL values outside the bounds; one-sided bounds allowed."""
    pred = P.out_of_range(df, column, min_value, max_value, inclusive)
    return row_check(df, pred, metadata={"column": column, "min": min_value, "max": max_value,
                                         "inclusive": inclusive})


def range_summary(df: DataFrame, bounds: list[tuple[str, object]]) -> DataFrame:
    """One row per labelled condition with its count - one scan, then unpivot.

    ``bounds`` is a list of (label, Column) pairs, e.g.
    ``[("hours < 0", F.col("hours") < 0), ("hours > 24", F.col("hours") > 24)]``.
    """
    labels = [f"b{i}" for i in range(len(bounds))]
    wide = df.agg(*[F.count_if(cond).cast("bigint").alias(lab) for lab, (_, cond) in zip(labels, bounds)])
    long = wide.unpivot([], labels, "__slot", "violation_count")
    names = F.create_map(*[x for lab, (name, _) in zip(labels, bounds) for x in (F.lit(lab), F.lit(name))])
    return long.select(names[F.col("__slot")].alias("violation_type"), "violation_count")


def date_range(df: DataFrame, column: str, start=None, end=None) -> Outcome:
    """Dates before ``start`` or after ``end``."""
    pred = P.outside_dates(df, column, start, end)
    return row_check(df, pred, metadata={"column": column, "min": str(start), "max": str(end)})


def future_dates(df: DataFrame, column: str, as_of=None) -> Outcome:
    """Dates later than ``as_of``, by default the time the query runs (give one for reproducible runs)."""
    return row_check(df, P.after(df, column, as_of), metadata={"column": column, "as_of": str(as_of or "now")})


def cross_field(df: DataFrame, left: str, operator: str, right: str) -> Outcome:
    """Rows where ``left <operator> right`` does not hold (NULL sides skipped)."""
    return row_check(df, P.cross_field(left, operator, right),
                     metadata={"left": left, "operator": operator, "right": right})
