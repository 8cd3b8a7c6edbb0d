"""Completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions import predicates as P
from sieve.operators.base import Outcome, row_check


def completeness(df: DataFrame, columns: list[str], check_empty_strings: bool = True,
                 check_whitespace: bool = False) -> Outcome:
    """Rows with any listed column NULL (or empty / blank strings).

    Violations carry ``incomplete_fields``: the failing column names in rule
    order joined with ', '.
    """
    if not columns:
        raise ValueError("completeness check needs 'columns'")
    opts = dict(check_empty_strings=check_empty_strings, check_whitespace=check_whitespace)
    for c in columns:
        df.schema[c]  # fail early on unknown columns
    pred = P.any_missing(df, columns, **opts)
    return row_check(
        df, pred,
        metadata={"columns_checked": list(columns), "check_empty_strings": check_empty_strings,
                  "check_whitespace": check_whitespace},
        annotate={"incomplete_fields": P.incomplete_fields(df, columns, **opts)},
    )


def completeness_profile(df: DataFrame, columns: list[str], check_empty_strings: bool = False,
                         check_whitespace: bool = False) -> DataFrame:
    """Per column - total rows, missing count, missing percentage.

    One aggregate over the table (not one scan per column), then unpivoted to
    one row per column.
    """
    opts = dict(check_empty_strings=check_empty_strings, check_whitespace=check_whitespace)
    counts = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_records"),
        *[F.count_if(P.missing(df, c, **opts)).cast("bigint").alias(c) for c in columns],
    )
    long = counts.unpivot(["total_records"], list(columns), "column_name", "null_count")
    pct = F.when(F.col("total_records") > 0,
                 F.round(F.col("null_count").cast("double") / F.col("total_records") * 100, 4))
    return long.select("column_name", "total_records", "null_count", pct.alias("null_percentage"))


def first_missing_field(df: DataFrame, columns: list[str], keep: list[str] | None = None,
                        check_empty_strings: bool = False, check_whitespace: bool = False) -> DataFrame:
    """Rows with a missing field and the name of the first one."""
    opts = dict(check_empty_strings=check_empty_strings, check_whitespace=check_whitespace)
    keep = list(keep) if keep is not None else list(df.columns)
    return (df.filter(P.any_missing(df, columns, **opts))
              .select(*keep, P.first_missing(df, columns, **opts).alias("missing_field")))
