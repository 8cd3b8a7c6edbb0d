"""Reconciling two tables: multiset differences with counts, and what changed row by row.

Both sides are tagged and counted in one aggregation (partial, so a row that a third of a table repeats costs a row per task);
equal rows cancel there, and only what differs goes on. Keys are of bounded width (long texts by beginning and SHA-256).
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.predicates import is_string
from sieve.operators.base import Outcome
from sieve.operators.duplicates import short_key
from sieve.operators.skew import join_groups
from sieve.staging import stage

LEFT, RIGHT = "left_copies", "right_copies"


def _columns(left: DataFrame, right: DataFrame, columns: list[str] | None) -> list[str]:
    columns = list(columns or left.columns)
    if lacking := [c for c in columns if c not in left.columns or c not in right.columns]:
        raise ValueError(f"not in both tables: {', '.join(lacking)}")
    for c in columns:
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"column {c!r} has type {left.schema[c].dataType.simpleString()} on one side, {right.schema[c].dataType.simpleString()} on the other")
    return columns


def copies(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every distinct row of either table (over ``columns``, nulls equal) with how often each side has it."""
    columns = _columns(left, right, columns)
    both = left.select(*columns, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*columns, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    keys = [(short_key(F.col(c)) if is_string(both, c) else F.col(c)).alias(f"__k{i}") for i, c in enumerate(columns)]
    values = [(F.min(c) if is_string(both, c) else F.first(c)).alias(c) for c in columns]
    counted = both.groupBy(*keys).agg(*values, F.sum("__l").cast("bigint").alias(LEFT), F.sum("__r").cast("bigint").alias(RIGHT))
    return counted.select(*columns, LEFT, RIGHT)


def except_all(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that the left side has more often, and by how much (``copies``): EXCEPT ALL, a row per distinct row."""
    found = copies(left, right, columns).where(F.col(LEFT) > F.col(RIGHT))
    return found.withColumn("copies", F.col(LEFT) - F.col(RIGHT)).drop(LEFT, RIGHT)


def intersect_all(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that both sides have, and how often both do (``copies``): INTERSECT ALL, a row per distinct row."""
    found = copies(left, right, columns).where((F.col(LEFT) > 0) & (F.col(RIGHT) > 0))
    return found.withColumn("copies", F.least(LEFT, RIGHT)).drop(LEFT, RIGHT)


def reconcile(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> Outcome:
    """Rows that one side has more often than the other: violations with ``left_copies`` and ``right_copies``.

    ``violation_count`` is the number of rows too many or too few, repeats counted; the summary has them by side."""
    columns = _columns(left, right, columns)

    @cache
    def differing() -> DataFrame:
        return stage(copies(left, right, columns).where(F.col(LEFT) != F.col(RIGHT)), "differing")

    def summary() -> DataFrame:
        more, less = (F.coalesce(F.sum(F.greatest(a - b, F.lit(0))), F.lit(0)).cast("bigint") for a, b in (
            (F.col(LEFT), F.col(RIGHT)), (F.col(RIGHT), F.col(LEFT))))
        return differing().agg((more + less).alias("violation_count"), more.alias("only_left"), less.alias("only_right"),
                               F.count(F.lit(1)).cast("bigint").alias("distinct_rows"))

    return Outcome(violations=differing, summary=summary, metadata={"columns_compared": columns}, sample_order=[F.col(c).asc_nulls_first() for c in columns])


def row_changes(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """What happened to the rows between ``left`` (before) and ``right`` (after), by key: keys, ``change``, ``changed_columns``, ``before``, ``after`` (structs of
    the other columns; null if there is none) and ``copies``.

    ``changed``: one row of the key is left over on each side; their differing columns are named, in order. ``removed`` and ``added``: all
    other rows left over, repeats counted in ``copies``. Equal rows cancel first. Nulls in keys are equal."""
    columns = _columns(left, right, columns)
    rest = [c for c in columns if c not in keys]
    if lacking := [k for k in keys if k not in columns]:
        raise ValueError(f"keys not compared: {', '.join(lacking)}")
    over = copies(left, right, columns).where(F.col(LEFT) != F.col(RIGHT))
    over = over.select(*columns, (F.col(LEFT) - F.col(RIGHT)).alias("__n"))
    over = stage(over, "left-over")
    per_key = over.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(
        F.sum(F.greatest("__n", F.lit(0))).alias("__gone"), F.sum(F.greatest(-F.col("__n"), F.lit(0))).alias("__new"))
    judged = join_groups(over, per_key, [(k, f"__g{i}") for i, k in enumerate(keys)], "inner", null_safe=True, prefilter=False)  # every row has a group
    pair = (F.col("__gone") == 1) & (F.col("__new") == 1)
    row = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))
    before, after = (F.when(F.col("__n") > 0, row), F.when(F.col("__n") < 0, row))
    # Two rows a key.
    changed = judged.where(pair).groupBy(*keys).agg(F.first(before, ignorenulls=True).alias("before"), F.first(after, ignorenulls=True).alias("after"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in rest])) if rest else F.array().cast("array<string>")
    changed = changed.select(*keys, F.lit("changed").alias("change"), names.alias("changed_columns"), "before", "after", F.lit(1).cast("bigint").alias("copies"))
    alone = judged.where(~pair).select(*keys, F.when(F.col("__n") > 0, "removed").otherwise("added").alias("change"), F.lit(None).cast("array<string>").alias("changed_columns"),
                                       before.alias("before"), after.alias("after"), F.abs("__n").cast("bigint").alias("copies"))
    return changed.unionByName(alone)
