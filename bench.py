"""Benchmark: headline checks at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "headline_total", "value": <sum of medians>, "unit": "sec",
   "queries": {...}, "alternatives": {...}, "sf": ..., ...}

Every timing is the median of $BENCH_RUNS warm runs (one untimed warm-up
first). Violation DataFrames are forced with the ``noop`` sink, so all rows
and columns are computed without collecting them. ``alternatives`` holds the
plans we compare against (one job per rule, window count, approximate
quartiles, sort-merge anti join); they are not part of ``value``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def session():
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master(f"local[{CPUS}]").appName("sieve-bench")
         .config("spark.sql.shuffle.partitions", str(max(8, 2 * CPUS)))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
         .config("spark.sql.session.timeZone", "UTC"))
    if os.environ.get("BENCH_EVENT_LOG"):
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", os.environ["BENCH_EVENT_LOG"])
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from sieve.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    return s


def force(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    fn()  # warm-up
    times = []
    for _ in range(RUNS):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 3)


def main():
    spark = session()
    from sieve.operators import completeness as C
    from sieve.operators import duplicates as D
    from sieve.operators import outliers as O
    from sieve.operators import patterns as PT
    from sieve.operators import ranges as N
    from sieve.operators import referential as R
    from sieve.plans.catalog import QUERIES
    from sieve.plans.flagship import flagship_report
    from sieve.plans.fused import fused_counts
    from sieve.sources.tables import read_tables

    t = read_tables(spark, SF_DIR, ["lineitem", "orders", "customer", "events", "part", "documents"])
    li, ev = t["lineitem"], t["events"]

    def row_rules():
        return {
            "quantity_range": N.value_range(li, "l_quantity", 1, 45),
            "discount_range": N.value_range(li, "l_discount", 0, 0.08),
            "returnflag_format": PT.pattern(li, "l_returnflag", "^[AR]$"),
            "shipdate_future": N.future_dates(li, "l_shipdate", "2001-06-30"),
            "completeness": C.completeness(li, ["l_returnflag", "l_linestatus", "l_orderkey"]),
        }

    keys = ["l_orderkey", "l_linenumber"]
    cust_pos = t["customer"].filter(F.col("c_acctbal") > 0)

    headline = {
        "e1_flagship_suite": lambda: flagship_report(spark, SF_DIR).results.collect(),
        "e6_fused_row_rules": lambda: fused_counts(li, row_rules()).collect(),
        "d1_excess_duplicates": lambda: D.duplicates(li, keys).summary.collect(),
        "d3_members_joinback": lambda: force(D.duplicate_members(li, keys)),
        "o5_iqr_exact": lambda: force(O.iqr(ev, "value", 1.5).violations),
        "o1_zscore": lambda: force(O.zscore(ev, "value", 3).violations),
        "r1_orphans": lambda: force(R.orphans(t["orders"], "o_custkey", cust_pos, "c_custkey").violations),
        "r5_multi_parent": lambda: force(QUERIES["r5_multi_parent_orphans"](spark, SF_DIR)),
        "n7_cross_field_join": lambda: force(QUERIES["n7_cross_field"](spark, SF_DIR)),
        "d7_fuzzy_blocks": lambda: force(QUERIES["d7_fuzzy_duplicates"](spark, SF_DIR)),
        "p3_regex_documents": lambda: force(QUERIES["p3_pattern_inverse"](spark, SF_DIR)),
    }

    def window_members():
        w = Window.partitionBy(*keys)
        force(li.withColumn("group_size", F.count(F.lit(1)).over(w)).filter(F.col("group_size") > 1))

    def sort_merge_orphans():
        keys_df = cust_pos.select(F.col("c_custkey").alias("k")).hint("merge")
        src = t["orders"].filter(F.col("o_custkey").isNotNull())
        force(src.join(keys_df, src["o_custkey"] == keys_df["k"], "left_anti"))

    alternatives = {
        "e6_one_job_per_rule": lambda: [o.summary.collect() for o in row_rules().values()],
        "d3_members_window": window_members,
        "o8_iqr_approx": lambda: force(O.iqr(ev, "value", 1.5, quartiles="approx").violations),
        "r1_orphans_sort_merge": sort_merge_orphans,
    }

    q = {name: timed(fn) for name, fn in headline.items()}
    alt = {name: timed(fn) for name, fn in alternatives.items()}
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(q.values()), 3), "unit": "sec", "queries": q,
        "alternatives": alt, "sf": float(sf.group(1)) if sf else SF_DIR, "cpus": CPUS, "runs": RUNS,
        "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "lineitem_rows": li.count(), "warm": True,
    }))


if __name__ == "__main__":
    main()
