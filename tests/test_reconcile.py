"""Multiset reconciliation and row changes against counters; the quality cube; shared statistics; nested values; profiles."""

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieve.operators import column_stats as CS
from sieve.operators import nested as NE
from sieve.operators import outliers as O
from sieve.operators import quantiles as Q
from sieve.operators import reconcile as RC
from sieve.operators import sketches as SK
from sieve.plans.cube import CubePart, quality_cube
from sieve.plans.suite import run_suite

SCHEMA = "k long, a string, b double"


def two(spark, seed=0):
    rng = random.Random(seed)
    pick = lambda: (rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["x", "y" * 300, "", None]), rng.choice([1.5, None]))
    left, right = [pick() for _ in range(200)], [pick() for _ in range(180)]
    return left, right, spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(2)


def as_counter(df):
    return Counter({tuple(r[c] for c in ("k", "a", "b")): r["copies"] for r in df.collect()})


def test_multiset_difference_and_intersection(spark):
    left, right, ld, rd = two(spark)
    l, r = Counter(left), Counter(right)
    assert as_counter(RC.except_all(ld, rd)) == l - r and as_counter(RC.except_all(rd, ld)) == r - l
    assert as_counter(RC.intersect_all(ld, rd)) == l & r
    out = RC.reconcile(ld, rd)
    row = out.summary.first()
    assert (row["only_left"], row["only_right"]) == (sum((l - r).values()), sum((r - l).values())) and row["violation_count"] == row["only_left"] + row["only_right"]
    assert {tuple(v)[:3] for v in out.violations.collect()} == {x for x in l | r if l[x] != r[x]}
    assert RC.reconcile(ld, ld.repartition(7)).summary.first()["violation_count"] == 0
    assert RC.reconcile(ld.where("false"), rd.where("false")).summary.first()["violation_count"] == 0


def test_row_changes(spark):
    before = [(1, "same", 1.0), (2, "old", 2.0), (3, "gone", 3.0), (4, "twice", 4.0), (4, "twice", 4.0), (None, "n", 0.0), (6, None, None)]
    after = [(1, "same", 1.0), (2, "new", None), (5, "added", 5.0), (4, "twice", 4.0), (None, "m", 0.0), (6, None, 1.0), (4, "other", 9.0), (4, "other", 9.0)]
    got = RC.row_changes(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA), ["k"]).collect()
    seen = sorted(((r["k"], r["change"], tuple(r["changed_columns"] or ()), r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"]), r["copies"]) for r in got), key=str)
    assert seen == sorted([
        (2, "changed", ("a", "b"), ("old", 2.0), ("new", None), 1), (None, "changed", ("a",), ("n", 0.0), ("m", 0.0), 1), (6, "changed", ("b",), (None, None), (None, 1.0), 1),
        (3, "removed", (), ("gone", 3.0), None, 1), (5, "added", (), None, ("added", 5.0), 1), (4, "removed", (), ("twice", 4.0), None, 1),
        (4, "added", (), None, ("other", 9.0), 2)], key=str)


def test_tables_that_cannot_be_compared(spark):
    left = spark.createDataFrame([(1, "a")], "k long, a string")
    with pytest.raises(ValueError):
        RC.reconcile(left, left.withColumnRenamed("a", "b"))
    with pytest.raises(ValueError):
        RC.reconcile(left, left.withColumn("a", F.lit(1)))
    with pytest.raises(ValueError):
        RC.row_changes(left, left, ["a"], ["k"])


def test_a_repeated_row_is_counted_before_it_is_shuffled(spark):
    hot = spark.range(50_000).select(F.lit(1).alias("k"))
    plan = RC.copies(hot, hot.limit(10))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    row = RC.copies(hot, hot.limit(10)).first()
    assert (row["left_copies"], row["right_copies"]) == (50_000, 10)


def test_cube_totals_and_dimensions(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}", "ab"[i % 2] if i % 5 else None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, d string, s string, v double").withColumn("ts", F.col("d").cast("timestamp"))
    part = CubePart("t", df, {"high": F.col("v") > 40, "null_segment": F.col("s").isNull()}, "ts", {"segment": F.col("s")})
    empty = CubePart("none", df.where("id < 0"), {"high": F.col("v") > 40}, "ts")
    got = quality_cube([part, empty]).collect()
    total = next(r for r in got if r["grouping_id"] == 15)
    assert (total["rows_checked"], total["violations"]) == (120, 19 + 12)
    by_null = [r for r in got if r["grouping_id"] == 14 and r["segment"] is None]  # the null segment itself, not a total
    assert len(by_null) == 1 and by_null[0]["rows_checked"] == 24
    assert {r["grouping_id"] for r in got} == set(range(16))
    one = quality_cube([CubePart("t", df, part.rules)], [("rule_name",)]).collect()
    assert {(r["rule_name"], r["violations"], r["day"]) for r in one} == {("high", 19, None), ("null_segment", 12, None)}
    with pytest.raises(ValueError):
        quality_cube([part], [("colour",)])
    with pytest.raises(ValueError):
        quality_cube([CubePart("t", df, part.rules, None, {"day": F.col("s")})])


# ---------------------------------------------------------------------------------------------------- shared statistics
def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def numbers(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.choice([1.0, 2.0, float("nan"), None]), float(rng.randint(0, 9))) for i in range(500)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


def test_one_pass_for_all_columns(spark):
    df = numbers(spark)
    found, n = jobs(spark, lambda: CS.column_statistics(df, ["x", "y", "z"], []))
    assert n <= 2  # AQE runs a stage's shuffle as a job of its own; a pass for each column would take three times as many
    one, per = jobs(spark, lambda: CS.column_statistics(df, ["x"], []))
    assert n == per and found["x"] == one["x"]
    assert found["y"]["n"] == df.where("y is not null and not isnan(y)").count()


@pytest.mark.parametrize("exact", [10**6, 0])
def test_shared_statistics_give_the_same_outliers(spark, exact):
    df = numbers(spark)
    stats = CS.column_statistics(df, ["x", "z"], ["x", "y", "z"], exact_values=exact)
    for c in ("x", "z"):
        alone, shared = O.zscore(df, c, 2), O.zscore(df, c, 2, statistics=stats[c])
        assert alone.metadata == shared.metadata and alone.violations.count() == shared.violations.count()
    for c in ("x", "y", "z"):
        alone, shared = O.iqr(df, c), O.iqr(df, c, statistics=stats[c])
        assert alone.metadata == shared.metadata
    empty = CS.column_statistics(df.where("id < 0"), ["x"], ["x"], exact_values=exact)["x"]
    assert empty == {"n": 0, "mean": None, "std": None, "q": (None, None, None)}


def test_a_suite_shares_them_and_isolates_what_fails(spark):
    df = numbers(spark).withColumn("word", F.lit("abc"))
    rules = [{"name": f"{c}_{m}", "type": "outliers", "severity": "low", "table": "t", "column": c, "method": m} for c in "xz" for m in ("zscore", "iqr")]
    rules.append({"name": "broken", "type": "outliers", "severity": "low", "table": "t", "column": "word"})
    fused = {r["rule_name"]: r["violation_count"] for r in run_suite(spark, {"t": df}, rules[:4]).results.collect()}
    singly = {r["rule_name"]: r["violation_count"] for r in run_suite(spark, {"t": df}, rules[:4], {"fuse": False}).results.collect()}
    assert fused == singly and sum(fused.values()) > 0
    mixed = {r["rule_name"]: r for r in run_suite(spark, {"t": df}, rules).results.collect()}
    assert {n: mixed[n]["violation_count"] for n in fused} == fused and mixed["broken"]["error_message"]


def test_ranks_by_counts(spark):
    values = [1.0] * 700 + [2.0] * 5 + [float(i) for i in range(3, 200)] + [500.0] * 900
    df = Q.clean_values(spark.createDataFrame([(v,) for v in values], "x double").repartition(4), "x")
    for rank in (0, 699, 700, 704, 705, 900, 901, len(values) - 1):
        assert Q.by_counts(df, rank) == sorted(values)[rank]


def test_brackets_that_do_not_shrink_still_answer(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_ACCURACY", 1)
    values = [1.0] * 500 + [1.5, 1.6, 1.7] + [2.0] * 500
    df = Q.clean_values(spark.createDataFrame([(v,) for v in values], "x double"), "x")
    got = Q.order_statistics(df, [0, 500, 501, 1002], distinct_limit=1, accuracy=4)
    assert got == {0: 1.0, 500: 1.5, 501: 1.6, 1002: 2.0}


# --------------------------------------------------------------------------------------------------------- nested values
def nested_df(spark):
    rows = [(1, (None, [("a", 1), (None, None), None], {"x": [1, None], "y": None})), (2, ("", [], {})), (3, None), (4, ("b", None, None))]
    return spark.createDataFrame(rows, "id long, d struct<name: string, items: array<struct<s: string, n: int>>, m: map<string, array<int>>>")


def test_path_counts(spark):
    got = {r["path"]: (r["total_values"], r["missing_values"]) for r in NE.path_counts(nested_df(spark), ["d"]).collect()}
    assert got == {"d.name": (4, 3), "d.items": (4, 2), "d.items[].s": (3, 2), "d.items[].n": (3, 2), "d.m": (4, 2), "d.m{}": (2, 1), "d.m{}[]": (2, 1)}
    plain = {r["path"]: r["missing_values"] for r in NE.path_counts(nested_df(spark), ["d"], check_empty_strings=False).collect()}
    assert plain["d.name"] == 2
    assert {r["total_values"] for r in NE.path_counts(nested_df(spark).where("id < 0"), ["d"]).collect()} == {0}


def test_nested_violations_name_places(spark):
    out = NE.nested_completeness(nested_df(spark), ["d"], ["d.items[].n", "d.m{}[]"])
    got = {r["id"]: [(p["path"], p["positions"]) for p in r["missing_paths"]] for r in out.violations.collect()}
    assert got == {1: [("d.items[].n", [1, 2]), ("d.m{}[]", [1])]} and out.summary.first()["violation_count"] == 1
    with pytest.raises(ValueError):
        NE.nested_completeness(nested_df(spark), ["d"], ["d.nothing"])


def test_json_paths(spark):
    texts = ['{"a": {"b": 1}, "c": [1, null]}', '{"a": null}', "broken {", None, '{"c": []}', ""]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = {r["path"]: (r["total_values"], r["missing_values"]) for r in NE.json_path_counts(df, "j").collect()}
    assert got == {"j": (6, 3), "j.a.b": (3, 2), "j.c": (3, 1), "j.c[]": (2, 1)}
    some = {r["path"]: r["missing_values"] for r in NE.json_path_counts(df, "j", "a struct<b: int, z: int>").collect()}
    assert some == {"j": 3, "j.a.b": 2, "j.a.z": 3}
    assert [r["path"] for r in NE.json_path_counts(df.where("j = 'broken {'"), "j").collect()] == ["j"]


# --------------------------------------------------------------------------------------------------------------- profiles
def test_merged_profiles_equal_one_pass(spark):
    rng = random.Random(2)
    rows = [(dt.datetime(2024, 1, 1 + i % 4), rng.gauss(10, 3) if i % 9 else None, f"u{rng.randint(0, 400)}") for i in range(8000)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "ts timestamp, x double, u string")
    days = SK.day_profiles(df, "ts", ["x", "u"])
    assert days.count() == 10  # four days and the null day, two columns
    merged = {r["column_name"]: r for r in SK.merged_profile(days).collect()}
    whole = {r["column_name"]: r for r in SK.merged_profile(SK.day_profiles(df.withColumn("ts", F.lit("2024-01-01")), "ts", ["x", "u"])).collect()}
    for c in ("x", "u"):
        assert [merged[c][k] for k in ("n_rows", "n_nulls", "lowest", "highest")] == [whole[c][k] for k in ("n_rows", "n_nulls", "lowest", "highest")]
        exact = df.where("not coalesce(isnan(x), false)").agg(F.count_distinct(c)).first()[0]
        assert abs(merged[c]["distinct_estimate"] - exact) <= SK.DISTINCT_BOUND * exact
    values = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    for p, q in zip((0.25, 0.5, 0.75), merged["x"]["quantiles"], strict=True):
        assert abs(sum(v <= q for v in values) / len(values) - p) <= SK.RANK_BOUND
    mean = sum(values) / len(values)
    assert merged["x"]["mean"] == pytest.approx(mean) and merged["x"]["std_dev"] == pytest.approx((sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5)
    assert merged["u"]["quantiles"] is None and SK.merged_profile(days.where("false")).count() == 0


def test_a_day_is_replaced_and_others_stay(spark):
    from sieve.staging import scratch_path

    path = scratch_path(spark, "profiles")
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), float(d)) for d in (1, 2, 2, 3)], "ts timestamp, x double")
    SK.write_profiles(SK.day_profiles(df, "ts", ["x"]), path)
    again = spark.createDataFrame([(dt.datetime(2024, 1, 2), 50.0)], "ts timestamp, x double")
    SK.write_profiles(SK.day_profiles(again, "ts", ["x"]), path)
    row = SK.merged_profile(spark.read.parquet(path)).first()
    assert (row["n_rows"], row["lowest"], row["highest"]) == (3, 1.0, 50.0)
