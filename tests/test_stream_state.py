"""Streams that keep state: bounded keys, restart, late parents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieve.staging import scratch_path
from sieve.streaming import checks as S

SCHEMA = "k string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return S.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, file_glob="*.parquet", max_files_per_trigger=1)


def run(spark, source, out, **options):
    q, path = S.run_excess(spark, stream(spark, source), ["k"], out_dir=out, **options)
    q.awaitTermination()
    return path, tuple(S.excess_summary(spark, path, ["k"]).first())


def test_state_is_bounded_by_the_horizon_and_survives_a_restart(spark):
    source, out = scratch_path(spark, "streams/in"), scratch_path(spark, "streams/out")
    options = {"ts_column": "ts", "horizon": "10 hours"}
    arrive(spark, source, [(f"old{i}", at(0)) for i in range(50)] + [("a", at(0)), ("a", at(1)), (None, at(1))])
    path, got = run(spark, source, out, **options)
    assert got == (53, 52, 1) and S.open_keys(spark, path) == 52
    arrive(spark, source, [("a", at(9)), ("b", at(14))])  # old keys are more than ten hours behind the newest
    path, got = run(spark, source, out, **options)
    assert got == (55, 53, 2) and S.open_keys(spark, path) == 2
    arrive(spark, source, [("old1", at(20)), ("a", at(20)), ("c", None)])  # old1 begins anew; a is kept from hour nine; c does not stay open
    path, got = run(spark, source, out, **options)
    assert got == (58, 55, 3) and S.open_keys(spark, path) == 3
    assert len(spark.read.parquet(f"{path}/*/totals").collect()) <= 2  # older versions are gone


def test_without_a_horizon_every_key_counts(spark):
    source, out = scratch_path(spark, "streams/in"), scratch_path(spark, "streams/out")
    for h in (0, 100, 200):
        arrive(spark, source, [("a", at(h)), (f"b{h}", None)])
    assert run(spark, source, out)[1] == (6, 4, 2)
    assert run(spark, source, out)[1] == (6, 4, 2)  # nothing new: nothing counted again
    with pytest.raises(ValueError):
        S.run_excess(spark, stream(spark, source), ["k"], horizon="1 day")


def test_an_empty_stream_has_a_summary(spark):
    source = scratch_path(spark, "streams/in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert run(spark, source, scratch_path(spark, "streams/out"))[1] == (0, 0, 0)


def test_a_late_parent_clears_its_orphan(spark):
    children, parents = scratch_path(spark, "streams/c"), scratch_path(spark, "streams/p")
    arrive(spark, children, [("early", at(1)), ("late", at(2)), ("never", at(3)), ("too_late", at(3)), (None, at(3))])
    arrive(spark, parents, [("early", at(0)), ("other", at(2))])
    arrive(spark, children, [("done", at(30))])
    arrive(spark, parents, [("late", at(7)), ("too_late", at(20)), ("done", at(30))])  # five hours after its child; seventeen after
    for h in (400, 800):
        arrive(spark, children, [("end", at(h))])
        arrive(spark, parents, [("end", at(h))])
    found = S.late_parent_orphans(stream(spark, children), "k", "ts", stream(spark, parents), "k", "ts", before="6 hours", after="6 hours")
    with S.state_partitions(spark, 2):
        q, path = S.run_to_parquet(spark, found, "orphans")
        q.awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["never", "too_late"]
    assert spark.read.parquet(path).columns == ["k", "ts"] and spark.conf.get("spark.sql.shuffle.partitions") == "8"
