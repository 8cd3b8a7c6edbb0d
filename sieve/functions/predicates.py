"""Row predicates as Spark ``Column`` expressions.

Every builder returns a boolean Column that is TRUE exactly for a violating
row. A NULL result means "not a violation", so each predicate can be used in
``filter`` and in ``count_if`` alike, and several predicates on one table can
be evaluated in a single scan (see ``sieve.plans.suite``). All of them are
built-in expressions and stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions.patterns import resolve_pattern


def _field_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_string(df: DataFrame, column: str) -> bool:
    return isinstance(_field_type(df, column), (T.StringType, T.VarcharType, T.CharType))


def is_fractional(df: DataFrame, column: str) -> bool:
    return isinstance(_field_type(df, column), (T.DoubleType, T.FloatType))


def any_of(conds: list[Column]) -> Column:
    return reduce(or_, conds) if conds else F.lit(False)


# ---------------------------------------------------------------- completeness
def missing(df: DataFrame, column: str, check_empty_strings: bool = True,
            check_whitespace: bool = False) -> Column:
    """NULL, or (strings only) empty, or (optionally) spaces only.

    The empty/blank tests apply to string fields only: on a numeric field they
    would either fail under ANSI mode or, worse, match 0.
    """
    c = F.col(column)
    conds = [c.isNull()]
    if is_string(df, column):
        if check_empty_strings:
            conds.append(c == F.lit(""))
        if check_whitespace:
            conds.append(F.trim(c) == F.lit(""))
    return any_of(conds)


def any_missing(df: DataFrame, columns: list[str], **opts) -> Column:
    return any_of([missing(df, c, **opts) for c in columns])


def incomplete_fields(df: DataFrame, columns: list[str], **opts) -> Column:
    """C4: names of the failing columns in rule order, joined with ', '."""
    return F.concat_ws(", ", *[F.when(missing(df, c, **opts), F.lit(c)) for c in columns])


def first_missing(df: DataFrame, columns: list[str], **opts) -> Column:
    """Name of the first failing column of the row (NULL if none)."""
    return F.coalesce(*[F.when(missing(df, c, **opts), F.lit(c)) for c in columns])


# ---------------------------------------------------------------------- ranges
def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _present(df: DataFrame | None, column: str) -> Column:
    """Non-NULL and, for floating columns, not NaN (NaN is treated like NULL)."""
    c = F.col(column)
    if df is not None and is_fractional(df, column):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def out_of_range(df: DataFrame | None, column: str, min_value=None, max_value=None,
                 inclusive: bool = True) -> Column:
    """Outside ``[min, max]`` (inclusive) or ``(min, max)`` (exclusive).

    Either bound may be omitted; with neither the rule is invalid.
    """
    if min_value is None and max_value is None:
        raise ValueError("range check needs 'min' or 'max'")
    c = F.col(column)
    terms = []
    if min_value is not None:
        lo = _literal(min_value)
        terms.append(c < lo if inclusive else c <= lo)
    if max_value is not None:
        hi = _literal(max_value)
        terms.append(c > hi if inclusive else c >= hi)
    return _present(df, column) & any_of(terms)


def _typed(df: DataFrame | None, column: str, value) -> Column:
    """A bound as a literal of the column's own type (a '1996-01-01' string
    becomes a DATE / TIMESTAMP / TIMESTAMP_NTZ literal, never arithmetic)."""
    if isinstance(value, Column):
        return value
    if df is not None and isinstance(value, (str, _dt.date)):
        return F.lit(str(value) if isinstance(value, str) else value.isoformat()).cast(_field_type(df, column))
    return F.lit(value)


def outside_dates(df: DataFrame | None, column: str, start=None, end=None) -> Column:
    """date_range - before ``start`` or after ``end`` (typed literals, not arithmetic).

    ``end`` may be ``now``, the time the query runs; an explicit timestamp makes
    results reproducible.
    """
    c = F.col(column)
    terms = []
    if start is not None:
        terms.append(c < _typed(df, column, start))
    if end is not None:
        terms.append(c > _bound(df, column, end))
    if not terms:
        raise ValueError("date_range check needs 'min' or 'max'")
    return c.isNotNull() & any_of(terms)


def after(df: DataFrame | None, column: str, as_of=None) -> Column:
    """Future dates - strictly later than ``as_of``, by default now."""
    c = F.col(column)
    return c.isNotNull() & (c > _bound(df, column, as_of))


def _bound(df: DataFrame | None, column: str, value) -> Column:
    """A date bound; None and ``now`` are the time the query runs, as the column's own type."""
    if value is None or (isinstance(value, str) and value.lower() == "now"):
        now = F.current_timestamp()
        return now if df is None else now.cast(_field_type(df, column))
    return _typed(df, column, value)


_COMPARATORS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
}


def cross_field(left: str, operator: str, right: str) -> Column:
    """The rule states the relation that must hold (``end_date >= start_date``);
    a row violates it when both sides are set and the relation is false."""
    if operator not in _COMPARATORS:
        raise ValueError(f"unknown comparison operator {operator!r}")
    a, b = F.col(left), F.col(right)
    return a.isNotNull() & b.isNotNull() & ~_COMPARATORS[operator](a, b)


# -------------------------------------------------------------------- patterns
def pattern_violation(column: str, pattern: str, inverse: bool = False,
                      match_null: bool = True, must_contain: str | None = None) -> Column:
    """Value does not contain a match of the regex (anchors decide).

    ``inverse`` flags values that DO match. ``match_null=False`` makes NULL a
    violation; by default NULL is never flagged. ``must_contain``: a literal
    the caller knows every match includes (e.g. '@' for e-mail); values
    without it are decided by a cheap substring test before the regex runs.
    """
    c = F.col(column)
    hit = c.rlike(resolve_pattern(pattern))
    if must_contain:
        hit = c.contains(must_contain) & hit
    bad = hit if inverse else ~hit
    bad = c.isNotNull() & bad
    return bad if match_null else (bad | c.isNull())


def like_violation(column: str, pattern: str, inverse: bool = False,
                   match_null: bool = True) -> Column:
    """P5: SQL LIKE wildcard check (``%``/``_``), an explicit option, never an
    automatic rewrite of a regex."""
    c = F.col(column)
    hit = c.like(pattern)
    bad = c.isNotNull() & (hit if inverse else ~hit)
    return bad if match_null else (bad | c.isNull())
