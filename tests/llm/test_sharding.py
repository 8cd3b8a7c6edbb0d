"""Interleaving: counts, slots and mixture against brute force; no Python in the plan."""

import zlib
from collections import Counter

from llm_data import ROWS, awkward, empty
from pyspark.sql import functions as F

from sieve.llm import sharding as S


def test_digest(spark):
    got = S.shard_documents(awkward(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert S.shard_documents(empty(spark)).collect() == []


def test_every_shard_matches_the_mixture(spark):
    sizes = {"hot": 700, "b": 210, None: 97, "d": 13, "e": 1}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    got = S.interleave(df, shards=16, bucket_rows=50).collect()
    by_shard = {k: [r for r in got if r["shard"] == k] for k in range(16)}
    counts = [len(v) for v in by_shard.values()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        seen = Counter(r["source"] for r in part)
        assert all(abs(seen[s] - n / 16) < 2 for s, n in sizes.items())


def test_order_is_the_fractional_rank(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, source string")
    got = S.interleave(df, shards=1, bucket_rows=7).orderBy("slot").collect()
    sizes, place = Counter(r["source"] for r in got), Counter()
    fractions = []
    for r in got:
        place[r["source"]] += 1
        fractions.append((place[r["source"]] - 0.5) / sizes[r["source"]])
    assert fractions == sorted(fractions)
    again = S.interleave(df.repartition(7), shards=1, bucket_rows=1000).orderBy("slot").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in again]  # neither layout nor bucket size matters


def test_other_columns_pass_through(spark):
    df = awkward(spark).drop("shard", "slot")
    got = S.interleave(df, shards=4)
    assert got.columns == [*df.columns, "shard", "slot"] and got.count() == len(ROWS)
    assert got.where(F.col("text").isNull()).count() == 2


def test_plan_is_native(spark):
    plan = S.shard_documents(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_write_shards(spark):
    from sieve.llm.common import scratch_path

    path = scratch_path(spark, "shards")
    S.write_shards(awkward(spark, clash=False), path, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() == 3


def test_a_hot_id_is_spread_over_the_buckets(spark):
    def fullest(df, **ties):
        keyed = S._keyed(df, 30_000, 256, "doc_id", "source", 7, ties.get("ties", ()), 100)
        return keyed.groupBy("__sh_b").count().agg(F.max("count")).first()[0]

    ids = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id"))
    df = spark.range(30_000).select(ids.alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 1000).alias("text_crc32"))
    assert fullest(df) < 600 and fullest(df, ties=("text_crc32",)) < 600  # a third of the rows is 10,000
    got = S.interleave(df, shards=4, bucket_rows=100).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in got] == [(7500, 7500)] * 4
