"""Further registered queries: the plans for large parents and hot keys, rule validation and settings, the newer rule
types, duplicates on long texts and over several stream batches, and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import duplicates as D
from sieve.operators import referential as R
from sieve.plans import catalog as _c
from sieve.plans import flagship as _fs
from sieve.plans.rules import RuleError
from sieve.sources.tables import read_tables
from sieve.staging import scratch_path
from sieve.streaming import checks as S

register, _t = _c.register, _c._t

# ------------------------------------------------- hot valid keys, NULL keys, orphans: the plans for large parents
# A third of the orders have customer 1, some have none, some have one that does not exist.
_HOT_REF = "CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 7 = 1 THEN NULL WHEN o_orderkey % 11 = 2 THEN -o_custkey ELSE o_custkey END"
_HOT_ORDERS_SQL = f"(SELECT * REPLACE ({_HOT_REF} AS o_custkey) FROM orders)"


def _hot_orders(spark, d) -> DataFrame:
    return _t(spark, d, "orders").withColumn("o_custkey", F.expr(_HOT_REF))


@register("r1_orphans_split", f"""
SELECT o.* FROM {_HOT_ORDERS_SQL} o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def r1_orphans_split(spark, d):
    out = R.orphans(_hot_orders(spark, d), "o_custkey", _t(spark, d, "customer"), "c_custkey", allow_null=False, broadcast_limit=0)
    return out.violations


@register("r1_orphans_prefiltered", f"""
SELECT o.* FROM {_HOT_ORDERS_SQL} o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""")
def r1_orphans_prefiltered(spark, d):
    """The plan for large parents, with Bloom filters before both of its shuffles."""
    return R.orphans(_hot_orders(spark, d), "o_custkey", _t(spark, d, "customer"), "c_custkey", allow_null=False, broadcast_limit=0, prefilter=True).violations


@register("r3_orphan_keys_of_many_parents", """
SELECT s.ps AS s_nationkey, CAST(count(*) AS BIGINT) AS rows FROM (SELECT s_suppkey * 1000 + s_nationkey AS ps FROM supplier) s
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.ps) GROUP BY s.ps""")
def r3_orphan_keys_of_many_parents(spark, d):
    """Few child keys, many parent rows: parents that no child refers to are dropped before they are shuffled."""
    child = _t(spark, d, "supplier").select((F.col("s_suppkey") * 1000 + F.col("s_nationkey")).cast("long").alias("s_nationkey"))
    parent = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"))
    return R.orphan_keys(child, "s_nationkey", parent, "l_orderkey", prefilter=True)


@register("r5_multi_parent_split", _c.ORACLE["r5_multi_parent_orphans"])
def r5_multi_parent_split(spark, d):
    return _c._multi_parent(spark, d, broadcast_limit=0).violations


@register("g5_quality_score_nulls", _c._g5_sql(_HOT_ORDERS_SQL))
def g5_quality_score_nulls(spark, d):
    return _c._g5(spark, d, _hot_orders(spark, d))


@register("g5_quality_score_split", _c._g5_sql(_HOT_ORDERS_SQL))
def g5_quality_score_split(spark, d):
    return _c._g5(spark, d, _hot_orders(spark, d), broadcast_limit=0)


@register("d3_members_split", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS k FROM lineitem),
g AS (SELECT k, l_linenumber, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT t.*, g.group_size FROM t JOIN g USING (k, l_linenumber)""")
def d3_members_split(spark, d):
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey")).alias("k")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", key)
    return D.duplicate_members(rows, ["k", "l_linenumber"], shuffle=True)


@register("d3_members_prefiltered", """
WITH g AS (SELECT l_partkey, l_suppkey, l_quantity, CAST(count(*) AS BIGINT) AS group_size FROM lineitem
           WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_quantity IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, g.group_size FROM lineitem l JOIN g USING (l_partkey, l_suppkey, l_quantity)""")
def d3_members_prefiltered(spark, d):
    """Rows that are in no duplicated group are dropped by a Bloom filter of the groups before the join back shuffles."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return D.duplicate_members(rows, ["l_partkey", "l_suppkey", "l_quantity"], shuffle=True, prefilter=True)


@register("d3_members_documents_text", """
SELECT d.doc_id, g.group_size FROM documents d
JOIN (SELECT text, CAST(count(*) AS BIGINT) AS group_size FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) g
  ON d.text = g.text""")
def d3_members_documents_text(spark, d):
    """Long texts are keyed by their beginning and hash: no text is shuffled as a key or broadcast."""
    return D.duplicate_members(_t(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "group_size")


@register("d3_member_sample", """
WITH g AS (SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS group_size FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT l.*, g.group_size FROM lineitem l JOIN g ON l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.l_linenumber
ORDER BY l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate LIMIT 10""")
def d3_member_sample(spark, d):
    """The report's sample: the first 2 x sample_size of all member rows."""
    return D.member_sample(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 10)


# ------------------------------------------------------------------------------------------- rules (E5, E7, newer types)
_MALFORMED = [
    {"name": "bad_type", "type": "freshness", "table": "orders", "severity": "low"},
    {"name": "bad_severity", "type": "range", "table": "orders", "column": "o_totalprice", "min": 0, "severity": "urgent"},
    {"name": "bad_bounds", "type": "range", "table": "lineitem", "column": "l_tax", "severity": "low"},
    {"name": "bad_reference", "type": "referential_integrity", "table": "orders", "column": "o_custkey", "severity": "low"},
    {"name": "bad_query", "type": "custom_sql", "query": "  ", "severity": "low"},
    {"name": "lineitem_required", "type": "future_dates", "table": "orders", "column": "o_orderdate", "severity": "low"},
]


@register("e5_rule_validation", f"""
SELECT rule_name, passed, 'run' AS outcome FROM ({_c._SUITE_SQL}) r
UNION ALL SELECT * FROM (VALUES ('bad_type', false, 'refused'), ('bad_severity', false, 'refused'), ('bad_bounds', false, 'refused'),
  ('bad_reference', false, 'refused'), ('bad_query', false, 'refused'), ('lineitem_required', false, 'refused')) t""")
def e5_rule_validation(spark, d):
    """Each malformed rule has the whole suite refused before any job; without them the suite runs."""
    from sieve.plans.suite import run_suite

    tables, refused = read_tables(spark, d, _fs.FLAGSHIP_TABLES), []
    for rule in _MALFORMED:
        try:
            run_suite(spark, tables, [*_fs.FLAGSHIP_RULES, rule])
        except RuleError:
            refused.append((rule["name"], False, "refused"))
    rows = run_suite(spark, tables, _fs.FLAGSHIP_RULES).results.select("rule_name", "passed", F.lit("run").alias("outcome"))
    return rows.unionByName(spark.createDataFrame(refused, "rule_name string, passed boolean, outcome string"))


@register("e7_settings", f"""
SELECT r.rule_name, violation_count, CAST(CASE WHEN rule_type IN ('duplicates', 'uniqueness') THEN least(6, m.n)
                                         ELSE least(3, violation_count) END AS BIGINT) AS samples
FROM ({_c._SUITE_SQL}) r LEFT JOIN (
  {" UNION ALL ".join(f"SELECT '{n}' AS rule_name, CAST(({q}) AS BIGINT) AS n" for n, q in _c._S9_COUNTS if "unique" in n)}) m
USING (rule_name)""")
def e7_settings(spark, d):
    """Settings honoured: three samples a rule (six for duplicates), no fusing, no parallel submission."""
    from sieve.plans.suite import run_suite

    settings = {"sample_size": 3, "fuse": False, "parallel_execution": False}
    res = run_suite(spark, read_tables(spark, d, _fs.FLAGSHIP_TABLES), _fs.FLAGSHIP_RULES, settings).results
    return res.select("rule_name", "violation_count", F.size("sample_records").cast("bigint").alias("samples"))


_MORE_RULES = [
    {"name": "lineitem_parents", "type": "multi_parent", "severity": "high", "table": "lineitem", "links": [
        {"column": "l_partkey", "reference_table": "supplier", "reference_column": "s_suppkey"},
        {"column": "l_suppkey", "reference_table": "supplier", "reference_column": "s_suppkey"}]},
    {"name": "customer_idle", "type": "inactive_parents", "severity": "low", "table": "customer", "key": "c_custkey",
     "filter": "c_acctbal > 0", "child_table": "orders", "child_key": "o_custkey", "child_date": "o_orderdate",
     "within": "6 months", "as_of": "2000-12-01 00:00:00"},
    {"name": "customer_idle_now", "type": "inactive_parents", "severity": "low", "table": "customer", "key": "c_custkey",
     "child_table": "orders", "child_key": "o_custkey", "child_date": "o_orderdate", "within": "180 days"},
    {"name": "ship_after_order", "type": "child_after_parent", "severity": "low", "table": "lineitem", "child_key": "l_orderkey",
     "child_date": "l_shipdate", "parent_table": "orders", "parent_key": "o_orderkey", "parent_date": "o_orderdate",
     "parent_filter": "o_orderstatus = 'F'"},
    {"name": "ship_future", "type": "future_dates", "severity": "low", "table": "lineitem", "column": "l_shipdate"},
    {"name": "order_window_now", "type": "date_range", "severity": "low", "table": "orders", "column": "o_orderdate",
     "min": "1996-01-01", "max": "now"},
]


@register("e1_more_rule_types", """
SELECT 'lineitem_parents' AS rule_name, CAST(count(*) AS BIGINT) AS violation_count FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_partkey)
     OR NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
UNION ALL SELECT 'customer_idle', count(*) FROM customer c WHERE c_acctbal > 0 AND NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2000-12-01' - INTERVAL 6 MONTH)
UNION ALL SELECT 'customer_idle_now', count(*) FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= current_timestamp::TIMESTAMP - INTERVAL 180 DAY)
UNION ALL SELECT 'ship_after_order', count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderstatus = 'F' AND l.l_shipdate > o.o_orderdate
UNION ALL SELECT 'ship_future', count(*) FROM lineitem WHERE l_shipdate > current_timestamp::TIMESTAMP
UNION ALL SELECT 'order_window_now', count(*) FROM orders
  WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > current_timestamp::TIMESTAMP""")
def e1_more_rule_types(spark, d):
    from sieve.plans.suite import run_suite

    tables = read_tables(spark, d, ["lineitem", "orders", "customer", "supplier"])
    return run_suite(spark, tables, _MORE_RULES).results.select("rule_name", "violation_count")


# ------------------------------------------------------------------------------------------------------------ streams
@register("t4_stream_excess", """
SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS rows_out,
       CAST(count(*) - count(DISTINCT (user_id, event_type)) AS BIGINT) AS violation_count FROM events""")
def t4_stream_excess(spark, d):
    """Excess rows over four files in four batches."""
    q, path = S.run_excess(spark, _c._events_in_files(spark, d, max_files=1), ["user_id", "event_type"])
    q.awaitTermination()
    return S.excess_summary(spark, path, ["user_id", "event_type"])


@register("t2_stream_late_rows", """
SELECT CAST(ts AS DATE) AS window_date, CAST(count(*) AS BIGINT) AS records_checked,
       CAST(count_if(value > 300) AS BIGINT) AS high_value FROM events GROUP BY CAST(ts AS DATE)""")
def t2_stream_late_rows(spark, d):
    """Append mode, a file a batch: the events; their last ones again, a year later, twice, which lets all windows close; and
    all events once more, too late to count. The windows of the first file are what comes out."""
    ev = _t(spark, d, "events")
    path = scratch_path(spark, "streams/late")
    last = ev.agg(F.max("ts")).first()[0]
    later = ev.where(F.col("ts") == F.lit(last)).withColumn("ts", (F.col("ts") + F.expr("INTERVAL 400 DAYS")).cast(ev.schema["ts"].dataType))
    for part in (ev, later, later, ev):  # rows are late against the watermark of the batch before
        part.coalesce(1).write.mode("append").parquet(path)
    stream = S.file_stream(spark, path, ev.schema, file_glob="*.parquet", max_files_per_trigger=1)
    trend = S.windowed_trend(stream, "ts", {"high_value": F.col("value") > 300}, watermark="1 day")
    q, out = S.run_to_parquet(spark, trend, "late_rows")
    q.awaitTermination()
    return spark.read.parquet(out).select(F.to_date("window.start").alias("window_date"), "records_checked", "high_value")
