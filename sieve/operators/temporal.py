"""Point-in-time checks: the state that held at an event's time (as-of join), and overlapping ranges.

Both work along the time order within a key and split hot keys (``operators.ordered``); neither compares rows pairwise.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.base import Outcome, count_summary
from sieve.operators.duplicates import free_name
from sieve.operators.ordered import carried, in_cells, window_in_cell

_ROW, _STATE, _KIND, _TIME = "__row", "__state", "__kind", "__time"


def _unset(columns: list[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def as_of_join(events: DataFrame, states: DataFrame, on: list[tuple[str, str]], time: tuple[str, str], columns: list[str] | dict[str, str], *,
               how: str = "left", strict: bool = False, within: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """Each event with the latest state of its key at its time.

    ``on``: pairs (event column, state column); ``time``: the event's and the state's time. ``columns``: state columns to add, or a mapping of them to their
    new names (an underscore is added to a name the events have). A state counts from its own moment on, with ``strict`` only after it; ``within``
    (an interval such as ``7 days``) ends its effect. Of several states of a key at one moment the one largest by ``tie`` holds (by default by the added columns).
    ``how``: ``left`` keeps events that no state precedes, with nulls; ``inner`` drops them.

    Cases: events with a null key or time have no state; states with a null key or time hold for none; empty tables on either side."""
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, got {how!r}")
    names = dict(columns) if isinstance(columns, dict) else {c: c for c in columns}
    keys = [f"__k{i}" for i in range(len(on))]
    e_time, s_time = time
    kept, final = events, {}
    for c, name in names.items():
        final[c] = free_name(kept, name)
        kept = kept.withColumn(final[c], F.lit(None))
    known = states.where(~_unset([s for _, s in on] + [s_time]))
    held = F.struct(F.col(s_time).alias("at"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    # One state per key and moment, so that repeated ones do not pile up.
    best = F.max_by(held, F.struct(*[F.col(c) for c in (tie or list(names))]))
    known = known.groupBy(*[F.col(s).alias(k) for k, (_, s) in zip(keys, on, strict=True)], F.col(s_time).alias(_TIME)).agg(best.alias(_STATE))
    timed = events.where(~_unset([e for e, _ in on] + [e_time]))
    kinds = dict(known.dtypes)
    # Written in one table, in order of time; at one moment states come first, or after the events if they are to hold only later.
    asked = timed.select(*[F.col(e).cast(kinds[k]).alias(k) for k, (e, _) in zip(keys, on, strict=True)], F.col(e_time).cast(kinds[_TIME]).alias(_TIME),
                         F.lit(0 if strict else 1).alias(_KIND), F.struct(*events.columns).alias(_ROW))
    given = known.select(*keys, _TIME, F.lit(1 if strict else 0).alias(_KIND), _STATE)
    rows = in_cells(asked.unionByName(given, allowMissingColumns=True), keys, [_TIME, _KIND])
    latest = F.max_by(F.when(F.col(_STATE).isNotNull(), F.col(_STATE)), F.when(F.col(_STATE).isNotNull(), F.col(_TIME)))
    rows = carried(rows, keys, {"__last": latest}, {"__before": F.last("__last", ignorenulls=True)}, {})
    own = F.last(_STATE, ignorenulls=True).over(window_in_cell(keys, [_TIME, _KIND]))
    rows = rows.withColumn("__held", F.coalesce(own, F.col("__before"))).where(F.col(_ROW).isNotNull())
    state = F.col("__held")
    if within is not None:
        state = F.when(F.col(_TIME) <= F.col("__held.at") + F.expr(f"INTERVAL {within}"), state)
    rows = rows.select(_ROW, state.alias("__held"))
    if how == "inner":
        rows = rows.where(F.col("__held").isNotNull())
    added = [F.col(f"__held.v{i}").alias(final[c]) for i, c in enumerate(names)]
    found = rows.select(*[F.col(_ROW)[c].alias(c) for c in events.columns], *added)
    if how == "inner":
        return found
    none = [F.lit(None).cast(states.schema[c].dataType).alias(final[c]) for c in names]
    return found.unionByName(events.where(_unset([e for e, _ in on] + [e_time])).select(*events.columns, *none))


def state_at_event(events: DataFrame, states: DataFrame, on: list[tuple[str, str]], time: tuple[str, str], columns: list[str] | dict[str, str],
                   violation: str, **options) -> Outcome:
    """Events whose parent was in a state it should not have been in at their time: Q5 against the parent's whole history.

    ``violation`` is a SQL condition over the events' columns and the added ``columns``; null (no state yet) is none."""
    @cache
    def found() -> DataFrame:
        return as_of_join(events, states, on, time, columns, **options).where(F.expr(violation))

    return Outcome(violations=found, summary=lambda: count_summary(found()), metadata={"on": on, "time": list(time), "violation": violation},
                   sample_order=[time[0]])


def overlaps(df: DataFrame, keys: list[str], start: str, end: str, *, inclusive: bool = False) -> Outcome:
    """Rows whose range [start, end) overlaps another row's of the same key (``inclusive``: [start, end]).

    Violations have ``earlier_end`` (the latest end among the ranges of the key that begin before it, or with it and come earlier) and
    ``later_start`` (the start of the next one): one of them lies within the row's own range. A row overlaps an earlier one just if it starts
    before the greatest end so far, and a later one just if the next starts before its end, so no pairs are made.

    Cases: rows with a null key, start or end, and empty or reversed ranges (``cross_field`` finds those), overlap nothing; repeated rows overlap
    each other; an empty table has no violations."""
    early, late = free_name(df, "earlier_end"), free_name(df, "later_start")
    meets = (lambda a, b: a <= b) if inclusive else (lambda a, b: a < b)
    proper = reduce(and_, [F.col(c).isNotNull() for c in [*keys, start, end]]) & meets(F.col(start), F.col(end))

    @cache
    def found() -> DataFrame:
        rows = in_cells(df.where(proper), keys, [start, end])
        rows = carried(rows, keys, {"__end": F.max(end), "__start": F.min(start)}, {"__ends": F.max("__end")}, {"__starts": F.min("__start")})
        w = window_in_cell(keys, [start, end])
        rows = rows.select("*", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__in_end"), F.lead(start).over(w).alias("__in_start"))
        rows = rows.withColumns({early: F.greatest("__in_end", "__ends"), late: F.coalesce("__in_start", "__starts")})
        hit = F.coalesce(meets(F.col(start), F.col(early)), F.lit(False)) | F.coalesce(meets(F.col(late), F.col(end)), F.lit(False))
        return rows.where(hit).select(*df.columns, early, late)

    return Outcome(violations=found, summary=lambda: count_summary(found()),
                   metadata={"keys": list(keys), "start": start, "end": end, "inclusive": inclusive}, sample_order=[*keys, start])


def overlap_clusters(df: DataFrame, keys: list[str], start: str, end: str, *, inclusive: bool = False) -> DataFrame:
    """Chains of overlapping ranges merged: keys, ``start``, ``end`` and ``ranges`` (how many rows a chain has, one or more).

    A chain begins where a range starts after the greatest end so far. Its number is the count of beginnings up to it, carried over the cells."""
    meets = (lambda a, b: a <= b) if inclusive else (lambda a, b: a < b)
    proper = reduce(and_, [F.col(c).isNotNull() for c in [*keys, start, end]]) & meets(F.col(start), F.col(end))
    rows = in_cells(df.where(proper).select(*keys, start, end), keys, [start, end])
    rows = carried(rows, keys, {"__end": F.max(end)}, {"__ends": F.max("__end")}, {})
    w = window_in_cell(keys, [start, end])
    so_far = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__ends"))
    rows = rows.withColumn("__new", F.when(F.coalesce(meets(F.col(start), so_far), F.lit(False)), 0).otherwise(1)).drop("__ends")
    rows = carried(rows, keys, {"__news": F.sum("__new")}, {"__chains": F.sum("__news")}, {})
    chain = F.coalesce("__chains", F.lit(0)) + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("__chain", chain).groupBy(*keys, "__chain")
            .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("ranges")).drop("__chain"))
