"""Pattern checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sieve.functions import predicates as P
from sieve.functions.patterns import resolve_pattern
from sieve.operators.base import Outcome, row_check


def pattern(df: DataFrame, column: str, pattern: str, inverse: bool = False,
            match_null: bool = True, must_contain: str | None = None) -> Outcome:
    """Regex (find semantics) on a string column; named patterns resolved."""
    if not pattern:
        raise ValueError("pattern check needs 'pattern'")
    regex = resolve_pattern(pattern)
    pred = P.pattern_violation(column, regex, inverse=inverse, match_null=match_null, must_contain=must_contain)
    return row_check(df, pred, metadata={"column": column, "pattern": regex, "inverse": inverse,
                                         "match_null": match_null})


def like(df: DataFrame, column: str, pattern: str, inverse: bool = False,
         match_null: bool = True) -> Outcome:
    """P5: SQL LIKE check."""
    pred = P.like_violation(column, pattern, inverse=inverse, match_null=match_null)
    return row_check(df, pred, metadata={"column": column, "like": pattern, "inverse": inverse,
                                         "match_null": match_null})
