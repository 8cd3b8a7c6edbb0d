"""Registered queries over whole tables: reconciliation, the quality cube, mergeable profiles, nested and JSON values, shared statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import column_stats as CS
from sieve.operators import nested as NE
from sieve.operators import reconcile as RC
from sieve.operators import sketches as SK
from sieve.operators.outliers import _r4
from sieve.plans import catalog as _c
from sieve.plans.cube import CubePart, quality_cube
from sieve.staging import scratch_path

register, _t = _c.register, _c._t

# ------------------------------------------------------------------------------------- reconciliation (EXCEPT / INTERSECT)
# The orders, and what another system has of them: some prices differ, some rows are missing, some are there twice, some statuses are null.
_THERE = "o_orderkey, o_custkey, CASE WHEN o_orderkey % 29 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority"
_LEFT = f"SELECT {_THERE}, o_orderstatus, o_totalprice FROM orders"
_RIGHT = f"""SELECT {_THERE}, CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 5"""
_RIGHT = f"({_RIGHT} UNION ALL SELECT * FROM ({_RIGHT}) again WHERE o_orderkey % 23 = 7)"
_LOOSE = ["o_custkey", "o_orderpriority", "o_orderstatus"]  # without the key: rows repeat


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, d, "orders")
    priority = F.when(F.col("o_orderkey") % 29 != 1, F.col("o_orderpriority")).alias("o_orderpriority")
    left = orders.select("o_orderkey", "o_custkey", priority, "o_orderstatus", "o_totalprice")
    right = orders.where("o_orderkey % 17 <> 5").select(
        "o_orderkey", "o_custkey", priority, F.when(F.col("o_orderkey") % 13 != 5, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return left, right.unionByName(right.where("o_orderkey % 23 = 7"))


@register("except_all_orders", f"""
SELECT {', '.join(_LOOSE)}, CAST(count(*) AS BIGINT) AS copies FROM (
  SELECT {', '.join(_LOOSE)} FROM ({_LEFT}) l EXCEPT ALL SELECT {', '.join(_LOOSE)} FROM {_RIGHT} r) t GROUP BY ALL""")
def except_all_orders(spark, d):
    return RC.except_all(*_both(spark, d), _LOOSE)


@register("intersect_all_orders", f"""
SELECT {', '.join(_LOOSE)}, CAST(count(*) AS BIGINT) AS copies FROM (
  SELECT {', '.join(_LOOSE)} FROM ({_LEFT}) l INTERSECT ALL SELECT {', '.join(_LOOSE)} FROM {_RIGHT} r) t GROUP BY ALL""")
def intersect_all_orders(spark, d):
    return RC.intersect_all(*_both(spark, d), _LOOSE)


@register("reconcile_orders", f"""
SELECT * FROM (
  SELECT {', '.join(_LOOSE)}, CAST(sum(l) AS BIGINT) AS left_copies, CAST(sum(r) AS BIGINT) AS right_copies FROM (
    SELECT {', '.join(_LOOSE)}, 1 AS l, 0 AS r FROM ({_LEFT}) a UNION ALL SELECT {', '.join(_LOOSE)}, 0, 1 FROM {_RIGHT} b) t GROUP BY ALL) c
WHERE left_copies <> right_copies""")
def reconcile_orders(spark, d):
    return RC.reconcile(*_both(spark, d), _LOOSE).violations


@register("reconcile_summary", f"""
WITH l AS (SELECT * FROM ({_LEFT}) a), r AS (SELECT * FROM {_RIGHT} b)
SELECT CAST((SELECT count(*) FROM (FROM l EXCEPT ALL FROM r)) + (SELECT count(*) FROM (FROM r EXCEPT ALL FROM l)) AS BIGINT) AS violation_count,
       CAST((SELECT count(*) FROM (FROM l EXCEPT ALL FROM r)) AS BIGINT) AS only_left, CAST((SELECT count(*) FROM (FROM r EXCEPT ALL FROM l)) AS BIGINT) AS only_right""")
def reconcile_summary(spark, d):
    return RC.reconcile(*_both(spark, d)).summary.drop("distinct_rows")


@register("reconcile_changes", f"""
WITH l AS (SELECT * FROM ({_LEFT}) a), r AS (SELECT * FROM {_RIGHT} b),
gone AS (SELECT *, count(*) AS n FROM (FROM l EXCEPT ALL FROM r) GROUP BY ALL), new AS (SELECT *, count(*) AS n FROM (FROM r EXCEPT ALL FROM l) GROUP BY ALL),
per AS (SELECT o_orderkey, sum(g) AS g, sum(w) AS w FROM (SELECT o_orderkey, n AS g, 0 AS w FROM gone UNION ALL SELECT o_orderkey, 0, n FROM new) GROUP BY 1)
SELECT o_orderkey, 'changed' AS change, CAST(concat_ws(',', CASE WHEN gone.o_custkey IS DISTINCT FROM new.o_custkey THEN 'o_custkey' END,
         CASE WHEN gone.o_orderpriority IS DISTINCT FROM new.o_orderpriority THEN 'o_orderpriority' END,
         CASE WHEN gone.o_orderstatus IS DISTINCT FROM new.o_orderstatus THEN 'o_orderstatus' END,
         CASE WHEN gone.o_totalprice IS DISTINCT FROM new.o_totalprice THEN 'o_totalprice' END) AS VARCHAR) AS changed_columns,
       gone.o_totalprice AS price_before, new.o_totalprice AS price_after, CAST(1 AS BIGINT) AS copies
FROM gone JOIN new USING (o_orderkey) JOIN per USING (o_orderkey) WHERE per.g = 1 AND per.w = 1
UNION ALL SELECT o_orderkey, 'removed', NULL, o_totalprice, NULL, CAST(n AS BIGINT) FROM gone JOIN per USING (o_orderkey) WHERE NOT (per.g = 1 AND per.w = 1)
UNION ALL SELECT o_orderkey, 'added', NULL, NULL, o_totalprice, CAST(n AS BIGINT) FROM new JOIN per USING (o_orderkey) WHERE NOT (per.g = 1 AND per.w = 1)""")
def reconcile_changes(spark, d):
    found = RC.row_changes(*_both(spark, d), ["o_orderkey"])
    return found.select("o_orderkey", "change", F.array_join("changed_columns", ",").alias("changed_columns"),
                        F.col("before.o_totalprice").alias("price_before"), F.col("after.o_totalprice").alias("price_after"), "copies")


# ------------------------------------------------------------------------------------------------------ quality cube
_CUBE_BASE = """
  SELECT 'orders' AS table_name, 'price_high' AS rule_name, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS segment, o_totalprice > 300000 AS bad FROM orders
  UNION ALL SELECT 'orders', 'status_open', CAST(o_orderdate AS DATE), o_orderpriority, o_orderstatus = 'O' FROM orders
  UNION ALL SELECT 'events', 'value_high', CAST(ts AS DATE), event_type, value > 300 FROM events
  UNION ALL SELECT 'events', 'error', CAST(ts AS DATE), event_type, event_type = 'error' FROM events"""


def _cube_sql(sets: str, dims: str) -> str:
    return f"""
SELECT {dims}, CAST(GROUPING_ID({dims}) AS BIGINT) AS grouping_id, CAST(count(*) AS BIGINT) AS rows_checked, CAST(count_if(bad) AS BIGINT) AS violations,
       CAST(count_if(bad) * 100.0 / count(*) AS DECIMAL(7,4)) AS violation_rate
FROM ({_CUBE_BASE}) t GROUP BY {sets}"""


def _cube_parts(spark, d, segments: bool) -> list[CubePart]:
    orders, events = _t(spark, d, "orders"), _t(spark, d, "events")
    return [CubePart("orders", orders, {"price_high": F.col("o_totalprice") > 300000, "status_open": F.col("o_orderstatus") == "O"}, "o_orderdate",
                     {"segment": F.col("o_orderpriority")} if segments else {}),
            CubePart("events", events, {"value_high": F.col("value") > 300, "error": F.col("event_type") == "error"}, "ts",
                     {"segment": F.col("event_type")} if segments else {})]


@register("g6_quality_cube", _cube_sql("CUBE (table_name, rule_name, day)", "table_name, rule_name, day"))
def g6_quality_cube(spark, d):
    """Every combination of table, rule and day, with subtotals."""
    return quality_cube(_cube_parts(spark, d, False))


@register("g6_quality_rollup_segments", _cube_sql(
    "GROUPING SETS ((table_name, rule_name, segment), (table_name, segment), (table_name, rule_name), (day), ())", "table_name, rule_name, day, segment"))
def g6_quality_rollup_segments(spark, d):
    """Chosen groupings, with a dimension of the tables' own."""
    return quality_cube(_cube_parts(spark, d, True), [("table_name", "rule_name", "segment"), ("table_name", "segment"), ("table_name", "rule_name"), ("day",), ()])


# ------------------------------------------------------------------------------------------------- mergeable profiles
_PROFILED = ("value", "user_id", "event_type")


@register("c5_profile_sketches", """
SELECT * FROM (VALUES ('value', 1), ('user_id', 1), ('event_type', 0)) c(column_name, numeric),
  LATERAL (SELECT CAST(count(*) AS BIGINT) AS n_rows,
    CAST(count_if(CASE column_name WHEN 'value' THEN value > 250 OR value IS NULL WHEN 'user_id' THEN user_id IS NULL ELSE event_type IS NULL END) AS BIGINT) AS n_nulls,
    CASE column_name WHEN 'value' THEN min(value) FILTER (value <= 250) WHEN 'user_id' THEN CAST(min(user_id) AS DOUBLE) END AS lowest,
    CASE column_name WHEN 'value' THEN max(value) FILTER (value <= 250) WHEN 'user_id' THEN CAST(max(user_id) AS DOUBLE) END AS highest,
    CASE column_name WHEN 'value' THEN round(avg(value) FILTER (value <= 250), 4) WHEN 'user_id' THEN round(avg(user_id), 4) END AS mean,
    CASE column_name WHEN 'value' THEN round(stddev_samp(value) FILTER (value <= 250), 4) WHEN 'user_id' THEN round(stddev_samp(user_id), 4) END AS std_dev,
    true AS distinct_within_bound, CASE WHEN numeric = 1 THEN true END AS quartiles_within_bound FROM events) t""".replace("SELECT * FROM (VALUES", "SELECT column_name, t.* FROM (VALUES"))
def c5_profile_sketches(spark, d):
    """A profile of each day is stored, the days are merged; estimates are held against exact figures. Values over 250 count as null."""
    events = _t(spark, d, "events").withColumn("value", F.when(F.col("value") <= 250, F.col("value")))
    path = scratch_path(spark, "profiles")
    SK.write_profiles(SK.day_profiles(events, "ts", list(_PROFILED)), path)
    merged = SK.merged_profile(spark.read.parquet(path))
    marks = {r["column_name"]: r["quantiles"] for r in merged.collect()}  # a row per column
    exact = []
    for c in _PROFILED:
        good = F.lit(None).cast("boolean")
        for p, q in zip((0.25, 0.5, 0.75), marks[c] or [], strict=False):
            # Of tied values the rank is anything from the first of them to the last.
            below, upto = F.count_if(F.col(c) < q) / F.count(c), F.count_if(F.col(c) <= q) / F.count(c)
            good = F.coalesce(good, F.lit(True)) & (below - SK.RANK_BOUND <= p) & (upto + SK.RANK_BOUND >= p)
        exact.append(events.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n_distinct"), good.alias("quartiles_within_bound")))
    held = merged.join(exact[0].unionByName(exact[1]).unionByName(exact[2]), "column_name")
    near = F.abs(F.col("distinct_estimate") - F.col("n_distinct")) <= F.greatest(SK.DISTINCT_BOUND * F.col("n_distinct"), F.lit(1))
    return held.select("column_name", "n_rows", "n_nulls", "lowest", "highest", F.round("mean", 4).alias("mean"), F.round("std_dev", 4).alias("std_dev"),
                       near.alias("distinct_within_bound"), "quartiles_within_bound")


# ------------------------------------------------------------------------------------------------ nested and JSON values
_DOC = """named_struct(
  'customer', named_struct('key', IF(o_orderkey % 10 = 3, NULL, o_custkey), 'segment', IF(o_orderkey % 7 = 2, '', o_orderpriority)),
  'flags', IF(o_orderkey % 11 = 4, NULL, array(o_orderstatus, IF(o_orderkey % 5 = 1, NULL, 'x'), 'z')),
  'items', array(named_struct('qty', IF(o_orderkey % 6 = 0, NULL, 1)), named_struct('qty', IF(o_orderkey % 9 = 8, NULL, 2))),
  'extra', map('a', IF(o_orderkey % 4 = 0, NULL, 'v'), 'b', 'w'))"""


@register("c1_nested_paths", """
SELECT path, CAST(total AS BIGINT) AS total_values, CAST(missing AS BIGINT) AS missing_values, round(CAST(missing AS DOUBLE) / total * 100, 4) AS missing_percentage FROM (
  SELECT 'doc.customer.key' AS path, count(*) AS total, count_if(o_orderkey % 10 = 3) AS missing FROM orders
  UNION ALL SELECT 'doc.customer.segment', count(*), count_if(o_orderkey % 7 = 2) FROM orders
  UNION ALL SELECT 'doc.flags', count(*), count_if(o_orderkey % 11 = 4) FROM orders
  UNION ALL SELECT 'doc.flags[]', 3 * count_if(o_orderkey % 11 <> 4), count_if(o_orderkey % 11 <> 4 AND o_orderkey % 5 = 1) FROM orders
  UNION ALL SELECT 'doc.items', count(*), 0 FROM orders
  UNION ALL SELECT 'doc.items[].qty', 2 * count(*), count_if(o_orderkey % 6 = 0) + count_if(o_orderkey % 9 = 8) FROM orders
  UNION ALL SELECT 'doc.extra', count(*), 0 FROM orders
  UNION ALL SELECT 'doc.extra{}', 2 * count(*), count_if(o_orderkey % 4 = 0) FROM orders) t""")
def c1_nested_paths(spark, d):
    return NE.path_counts(_t(spark, d, "orders").select(F.expr(_DOC).alias("doc")), ["doc"])


@register("c1_nested_violations", """
SELECT * FROM (SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 10 = 3 THEN 'doc.customer.key:0' END, CASE WHEN o_orderkey % 7 = 2 THEN 'doc.customer.segment:0' END,
  CASE WHEN o_orderkey % 11 = 4 THEN 'doc.flags:0' END, CASE WHEN o_orderkey % 11 <> 4 AND o_orderkey % 5 = 1 THEN 'doc.flags[]:1' END,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 9 = 8 THEN 'doc.items[].qty:0,1' WHEN o_orderkey % 6 = 0 THEN 'doc.items[].qty:0' WHEN o_orderkey % 9 = 8 THEN 'doc.items[].qty:1' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'doc.extra{}:0' END) AS missing FROM orders) t WHERE missing <> ''""")
def c1_nested_violations(spark, d):
    out = NE.nested_completeness(_t(spark, d, "orders").select("o_orderkey", F.expr(_DOC).alias("doc")), ["doc"])
    shown = F.transform("missing_paths", lambda p: F.concat(p["path"], F.lit(":"), F.array_join(F.transform(p["positions"], lambda i: i.cast("string")), ",")))
    return out.violations.select("o_orderkey", F.array_join(shown, " ").alias("missing"))


@register("c1_json_paths", """
WITH t AS (SELECT CASE WHEN event_id % 9 = 4 THEN '{"k": null}' WHEN event_id % 11 = 5 THEN '{}' WHEN event_id % 13 = 6 THEN 'no json' WHEN event_id % 17 = 3 THEN NULL
                       ELSE props END AS props FROM events),
j AS (SELECT *, props IS NULL OR props = 'no json' AS broken FROM t)
SELECT 'props' AS path, CAST(count(*) AS BIGINT) AS total_values, CAST(count_if(broken) AS BIGINT) AS missing_values,
       round(CAST(count_if(broken) AS DOUBLE) / count(*) * 100, 4) AS missing_percentage FROM j
UNION ALL SELECT 'props.k', CAST(count(*) AS BIGINT), CAST(count_if(props IN ('{"k": null}', '{}')) AS BIGINT), round(CAST(count_if(props IN ('{"k": null}', '{}')) AS DOUBLE) / count(*) * 100, 4)
FROM j WHERE NOT broken""")
def c1_json_paths(spark, d):
    """The type is found in the data; texts that are null or no JSON, and keys that are null or not there."""
    props = F.expr("""CASE WHEN event_id % 9 = 4 THEN '{"k": null}' WHEN event_id % 11 = 5 THEN '{}' WHEN event_id % 13 = 6 THEN 'no json'
                           WHEN event_id % 17 = 3 THEN NULL ELSE props END""")
    return NE.json_path_counts(_t(spark, d, "events").select(props.alias("props")), "props")


# ---------------------------------------------------------------------------------------------- statistics of many columns
_STAT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("o7_shared_statistics", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, round(quantile_cont({c}, 0.25), 4) AS q1,
       round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem""" for c in _STAT_COLUMNS))
def o7_shared_statistics(spark, d):
    """Moments and quartiles of four columns, as a suite takes them for all outlier rules of a table."""
    found = CS.column_statistics(_t(spark, d, "lineitem"), list(_STAT_COLUMNS), list(_STAT_COLUMNS))
    rows = [(c, s["n"], *[_r4(x) for x in (s["mean"], s["std"], *s["q"])]) for c, s in found.items()]
    return spark.createDataFrame(rows, "column_name string, n bigint, mean double, std_dev double, q1 double, median double, q3 double")
