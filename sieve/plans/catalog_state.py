"""Registered queries about time and state: as-of joins, overlapping ranges, late parents, keys with a horizon, run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import temporal as TM
from sieve.plans import catalog as _c
from sieve.plans import flagship as _fs
from sieve.plans import report as G
from sieve.sources import sinks as _sinks
from sieve.sources.tables import read_tables
from sieve.staging import scratch_path
from sieve.streaming import checks as S

register, _t = _c.register, _c._t

# ---------------------------------------------------------------------------------------------------- as-of joins (Q5)
# Events moved into the years of the orders, so that orders come before and after them. Hot: a third of them are user 1's.
_HOT_USER = "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 31 = 7 THEN NULL ELSE user_id END"


def _moved(spark, d, user: str = "user_id") -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.expr(user).alias("user_id"),
                                         F.expr("ts - make_dt_interval(CAST(8400 + event_id * 37 % 1900 AS INT))").alias("moment"))


def _moved_sql(user: str = "user_id") -> str:
    return f"SELECT event_id, {user} AS user_id, ts - to_days(CAST(8400 + event_id * 37 % 1900 AS INTEGER)) AS moment FROM events"


_STATES_SQL = """SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
  FROM orders GROUP BY o_custkey, o_orderdate"""


def _as_of(spark, d, events: DataFrame, **options) -> DataFrame:
    return TM.as_of_join(events, _t(spark, d, "orders"), [("user_id", "o_custkey")], ("moment", "o_orderdate"), ["o_orderkey", "o_orderstatus", "o_orderdate"],
                         tie=["o_orderkey"], **options)


def _as_of_sql(user: str = "user_id", compare: str = ">=") -> str:
    return f"""
WITH e AS ({_moved_sql(user)}), s AS ({_STATES_SQL})
SELECT e.*, s.o_orderkey, s.o_orderstatus, s.o_orderdate FROM e ASOF LEFT JOIN s ON e.user_id = s.o_custkey AND e.moment {compare} s.o_orderdate"""


@register("asof_orders_events", _as_of_sql())
def asof_orders_events(spark, d):
    """Each event with its customer's latest order before it."""
    return _as_of(spark, d, _moved(spark, d))


@register("asof_orders_events_hot", _as_of_sql(_HOT_USER))
def asof_orders_events_hot(spark, d):
    """The same where one user has a third of the events and some events have none."""
    return _as_of(spark, d, _moved(spark, d, _HOT_USER))


@register("asof_strict_within", f"""
WITH e AS (SELECT event_id, user_id, date_trunc('day', moment) AS moment FROM ({_moved_sql()})), s AS ({_STATES_SQL}),
j AS (SELECT e.*, s.o_orderkey, s.o_orderdate FROM e ASOF JOIN s ON e.user_id = s.o_custkey AND e.moment > s.o_orderdate)
SELECT * FROM j WHERE moment <= o_orderdate + INTERVAL 60 DAY""")
def asof_strict_within(spark, d):
    """Days with an order on an earlier day, 60 days back at most; an order on the day itself does not count."""
    events = _moved(spark, d).withColumn("moment", F.date_trunc("day", "moment").cast("timestamp_ntz"))
    return TM.as_of_join(events, _t(spark, d, "orders"), [("user_id", "o_custkey")], ("moment", "o_orderdate"), ["o_orderkey", "o_orderdate"],
                         how="inner", strict=True, within="60 days", tie=["o_orderkey"])


@register("q5_state_at_event", f"SELECT event_id, user_id, moment, o_orderstatus FROM ({_as_of_sql()}) t WHERE o_orderstatus = 'F'")
def q5_state_at_event(spark, d):
    """Events of customers whose latest order at that time was a failed one (not: whose order is failed today)."""
    out = TM.state_at_event(_moved(spark, d), _t(spark, d, "orders"), [("user_id", "o_custkey")], ("moment", "o_orderdate"), ["o_orderstatus"],
                            "o_orderstatus = 'F'", tie=["o_orderkey"])
    return out.violations


# -------------------------------------------------------------------------------------------------------- overlaps
def _ranges(spark, d, user: str = "user_id") -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.expr(user).alias("user_id"), F.col("ts").alias("starts"),
                                         F.expr("ts + make_dt_interval(0, 0, CAST(round(value) AS INT))").alias("ends"))


def _ranges_sql(user: str = "user_id") -> str:
    return f"SELECT event_id, {user} AS user_id, ts AS starts, ts + to_minutes(CAST(round(value) AS INTEGER)) AS ends FROM events"


def _overlap_sql(user: str = "user_id") -> str:
    return f"""
WITH w AS (
  SELECT *, max(ends) OVER (PARTITION BY user_id ORDER BY starts, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_end,
         lead(starts) OVER (PARTITION BY user_id ORDER BY starts, ends) AS later_start
  FROM ({_ranges_sql(user)}) r WHERE starts < ends AND user_id IS NOT NULL)
SELECT * FROM w WHERE starts < earlier_end OR later_start < ends"""


@register("n7_overlaps", _overlap_sql())
def n7_overlaps(spark, d):
    """Events as ranges of their value in minutes: those that overlap another of the same user."""
    return TM.overlaps(_ranges(spark, d), ["user_id"], "starts", "ends").violations


@register("n7_overlaps_hot", _overlap_sql(_HOT_USER))
def n7_overlaps_hot(spark, d):
    return TM.overlaps(_ranges(spark, d, _HOT_USER), ["user_id"], "starts", "ends").violations


@register("n7_overlap_clusters", f"""
WITH w AS (
  SELECT *, CASE WHEN starts < max(ends) OVER (PARTITION BY user_id ORDER BY starts, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n
  FROM ({_ranges_sql(_HOT_USER)}) r WHERE starts < ends AND user_id IS NOT NULL),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY starts, ends ROWS UNBOUNDED PRECEDING) AS chain FROM w)
SELECT user_id, min(starts) AS starts, max(ends) AS ends, CAST(count(*) AS BIGINT) AS ranges FROM c GROUP BY user_id, chain""")
def n7_overlap_clusters(spark, d):
    """Overlapping ranges merged into chains, one user having a third of the ranges."""
    return TM.overlap_clusters(_ranges(spark, d, _HOT_USER), ["user_id"], "starts", "ends")


# -------------------------------------------------------------------------------------------------- rules of these kinds
_STATE_RULES = [
    {"name": "event_in_state", "type": "state_at_event", "severity": "high", "table": "moved", "on": [("user_id", "o_custkey")], "time": "moment",
     "state_table": "orders", "state_time": "o_orderdate", "state_columns": ["o_orderstatus"], "violation": "o_orderstatus = 'F'", "tie": ["o_orderkey"]},
    {"name": "no_overlap", "type": "overlap", "severity": "medium", "table": "ranges", "keys": ["user_id"], "start": "starts", "end": "ends"},
    {"name": "same_orders", "type": "reconciliation", "severity": "critical", "table": "orders", "reference_table": "orders_copy",
     "columns": ["o_custkey", "o_orderstatus"]},
    {"name": "props_there", "type": "nested_completeness", "severity": "low", "table": "nested", "columns": ["who"]},
]


@register("e1_state_rules", f"""
SELECT 'event_in_state' AS rule_name, CAST(count(*) AS BIGINT) AS violation_count FROM ({_as_of_sql()}) t WHERE o_orderstatus = 'F'
UNION ALL SELECT 'no_overlap', count(*) FROM ({_overlap_sql()}) t
UNION ALL SELECT 'same_orders', 2 * count_if(o_orderstatus = 'P') FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT 'props_there', count_if(event_id % 5 = 2 OR event_type = 'error') FROM events""")
def e1_state_rules(spark, d):
    """The four rule types in a suite; the copy of the orders has some pending ones as open."""
    from sieve.plans.suite import run_suite

    tables = read_tables(spark, d, ["orders"])
    wrong = (F.col("o_orderkey") % 4 == 1) & (F.col("o_orderstatus") == "P")
    tables["orders_copy"] = tables["orders"].withColumn("o_orderstatus", F.when(wrong, F.lit("X")).otherwise(F.col("o_orderstatus")))
    tables["moved"], tables["ranges"] = _moved(spark, d), _ranges(spark, d)
    tables["nested"] = _t(spark, d, "events").select("event_id", F.expr(
        "named_struct('id', IF(event_id % 5 = 2, NULL, user_id), 'kind', NULLIF(event_type, 'error'))").alias("who"))
    return run_suite(spark, tables, _STATE_RULES).results.select("rule_name", "violation_count")


# ------------------------------------------------------------------------------------------------------------- streams
_CUTS = [dt.datetime(2024, 1, x) for x in (9, 16, 24)]


def _in_order(spark, df: DataFrame, name: str, closing: bool = False) -> DataFrame:
    """Events as a stream of four files in the order of time, a file a batch; ``closing`` adds two files of one row each, 400 days later, without a user that
    occurs, which lets all time spans close."""
    path = scratch_path(spark, f"streams/{name}")
    ts = F.col("ts")
    for low, high in zip([None, *_CUTS], [*_CUTS, None], strict=True):
        part = df if low is None else df.where(ts >= F.lit(low).cast("timestamp_ntz"))
        part = part if high is None else part.where(ts < F.lit(high).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(path)
    if closing:
        last = df.agg(F.max("event_id").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).cast("timestamp_ntz").alias("ts"))
        late = last.select(*[F.col(c) if c in last.columns else F.lit(-1).cast("bigint").alias(c) if c == "user_id" else
                             F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        for _ in range(2):
            late.coalesce(1).write.mode("append").parquet(path)
    return S.file_stream(spark, path, df.schema, file_glob="*.parquet", max_files_per_trigger=1)


@register("t3_stream_late_parents", """
SELECT c.event_id, c.user_id FROM events c WHERE c.event_type = 'purchase' AND c.user_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'signup' AND p.user_id = c.user_id
    AND p.ts BETWEEN c.ts - INTERVAL 3 DAY AND c.ts + INTERVAL 1 DAY)""")
def t3_stream_late_parents(spark, d):
    """Purchases without a signup of the user from three days before to one day after; both are streams, and signups may arrive in a later batch."""
    ev = _t(spark, d, "events")
    child = _in_order(spark, ev.where(F.col("event_type") == "purchase"), "children", closing=True)
    parent = _in_order(spark, ev.where(F.col("event_type") == "signup"), "parents", closing=True)
    found = S.late_parent_orphans(child, "user_id", "ts", parent, "user_id", "ts", before="3 days", after="1 day")
    with S.state_partitions(spark, 8):
        q, path = S.run_to_parquet(spark, found.select("event_id", "user_id"), "late_parents")
        q.awaitTermination()
    return spark.read.parquet(path)


@register("t4_stream_excess_horizon", f"""
WITH b AS (SELECT *, CASE WHEN ts < TIMESTAMP '{_CUTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{_CUTS[1]}' THEN 1 WHEN ts < TIMESTAMP '{_CUTS[2]}' THEN 2 ELSE 3 END AS batch FROM events),
k AS (SELECT user_id, event_type, batch, count(*) AS n, max(ts) AS last FROM b GROUP BY ALL),
m AS (SELECT batch, max(ts) AS newest FROM b GROUP BY batch),
g AS (SELECT k.*, lag(k.last) OVER (PARTITION BY user_id, event_type ORDER BY k.batch) AS previous,
             (SELECT max(newest) FROM m WHERE m.batch < k.batch) AS newest FROM k)
SELECT CAST(sum(n) AS BIGINT) AS rows_in, CAST(count_if(previous IS NULL OR previous < newest - INTERVAL 2 DAY) AS BIGINT) AS rows_out,
       CAST(sum(n) - count_if(previous IS NULL OR previous < newest - INTERVAL 2 DAY) AS BIGINT) AS violation_count FROM g""")
def t4_stream_excess_horizon(spark, d):
    """Four batches; a key whose last row is over two days older than the newest at the end of a batch begins anew after it."""
    q, path = S.run_excess(spark, _in_order(spark, _t(spark, d, "events"), "ordered"), ["user_id", "event_type"], ts_column="ts", horizon="2 days")
    q.awaitTermination()
    return S.excess_summary(spark, path, ["user_id", "event_type"])


# ------------------------------------------------------------------------------------------------ history of runs
@register("g7_history_of_runs", f"""
WITH r AS ({_c._SUITE_SQL}),
h AS (SELECT 1 AS run, count(*) AS total, count_if(NOT passed) AS failed FROM r
      UNION ALL SELECT 2, count(*), count_if(NOT passed) FROM r WHERE severity IN ('critical', 'high')
      UNION ALL SELECT 3, count(*), count_if(NOT passed) FROM r WHERE severity = 'low')
SELECT CAST(total AS BIGINT) AS total, CAST(failed AS BIGINT) AS failed, CAST(lag(failed) OVER (ORDER BY run) AS BIGINT) AS previous_failed,
       CAST(failed - lag(failed) OVER (ORDER BY run) AS BIGINT) AS failed_change FROM h""")
def g7_history_of_runs(spark, d):
    """Three runs of a suite appended to the history files, read back, and the trend over them."""
    from sieve.plans.suite import run_suite

    path = scratch_path(spark, "sinks/history")
    tables = read_tables(spark, d, _fs.FLAGSHIP_TABLES)
    for severities in (None, ["critical", "HIGH"], ["low"]):
        _sinks.append_history(run_suite(spark, tables, _fs.FLAGSHIP_RULES, severity_filter=severities, connection_name="testdata"), path)
    trend = G.history_trend(_sinks.read_history(spark, path))
    return trend.select("total", "failed", "previous_failed", "failed_change")
