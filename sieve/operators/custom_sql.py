"""Custom SQL checks (Q1-Q3) and cross-table consistency checks (Q4, Q5)."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators.base import Outcome, count_summary
from sieve.operators.skew import join_groups

COUNT_COLUMNS = ("violation_count", "count", "cnt", "total")


def custom_sql(spark: SparkSession, query: str, count_query: str | None = None) -> Outcome:
    """Q1/Q2: ``query`` returns the violating rows (over temp views); zero rows pass.

    With ``count_query`` the count is read from its first row: a column named
    violation_count / count / cnt / total, else the only column, else 0.
    """
    query = (query or "").strip()
    if not query:
        raise ValueError("a custom_sql rule is nothing without its 'query'")
    v = spark.sql(query)
    if count_query and count_query.strip():
        c = spark.sql(count_query.strip())
        cols = c.columns
        pick = next((x for x in COUNT_COLUMNS if x in cols), cols[0] if len(cols) == 1 else None)
        expr = F.coalesce(F.col(pick).cast("bigint"), F.lit(0)) if pick else F.lit(0).cast("bigint")
        # an empty count result reads as 0 (the suite treats a missing row as 0)
        summary = c.limit(1).select(expr.alias("violation_count"))
    else:
        summary = lambda: count_summary(v)
    return Outcome(violations=v, summary=summary,
                   metadata={"query": query, "custom_query": True, "has_count_query": bool(count_query)})


def inactive_parents(parent: DataFrame, key: str, child: DataFrame, child_key: str,
                     parent_filter=None, child_filter=None) -> Outcome:
    """Q4: parents (optionally filtered, e.g. status = 'active') with no matching
    child row among the filtered children (e.g. recent activity).

    A ``left_anti`` join, not ``NOT IN``: a NULL child key cannot empty the
    result, and the plan is not limited to a broadcast null-aware anti join.
    Child keys are reduced to distinct ones and written once, so a parent key that
    many parents share, or many NULLs, can be split (see ``operators.skew``).
    """
    p = parent.filter(parent_filter) if parent_filter is not None else parent
    c = child.filter(child_filter) if child_filter is not None else child
    keys = c.select(F.col(child_key).alias("__ck")).where(F.col("__ck").isNotNull()).distinct()

    @cache
    def violations() -> DataFrame:
        return join_groups(p, keys, [(key, "__ck")], "left_anti")

    return Outcome(violations=violations, summary=lambda: count_summary(violations()),
                   metadata={"key": key, "child_key": child_key})


def since(df: DataFrame, column: str, within: str, as_of=None) -> Column:
    """Rows whose date lies in the window of length ``within`` (``180 days``, ``6 months``) before ``as_of``, by default now."""
    found = re.fullmatch(r"\s*(\d+)\s*(hour|day|week|month|year)s?\s*", within.lower())
    if not found:
        raise ValueError(f"no time span {within!r}: give a number and hours, days, weeks, months or years")
    end = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {found[1]} {found[2].upper()}")
    return F.col(column) >= start.cast(df.schema[column].dataType)


def child_after_parent_event(child: DataFrame, child_key: str, child_date: str, parent: DataFrame,
                             parent_key: str, parent_date: str, parent_filter=None) -> Outcome:
    """Q5: child rows dated after their parent's date, for parents matching ``parent_filter``
    (e.g. services after the client became inactive). Equi join + residual predicate."""
    p = parent.filter(parent_filter) if parent_filter is not None else parent
    p = p.select(F.col(parent_key).alias("__pk"), F.col(parent_date).alias("__pdate"))
    j = child.join(p, child[child_key] == p["__pk"], "inner").filter(F.col(child_date) > F.col("__pdate"))
    v = j.drop("__pk", "__pdate")
    return Outcome(violations=v, summary=count_summary(v),
                   metadata={"child_date": child_date, "parent_date": parent_date})
