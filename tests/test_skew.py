"""Hot keys: one key holds a third of the rows, NULL another sixth. No partition of a join back to groups may hold a hot
key whole (thresholds are lowered so that the effect shows at test size)."""

import pytest
from pyspark.sql import functions as F

from sieve.operators import duplicates as D
from sieve.operators import referential as R
from sieve.operators.skew import join_groups
from sieve.plans import report as G

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}
N = 150_000


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    # 16 input files: AQE splits a hot partition by the map tasks it comes from
    yield spark.range(0, N, 1, 16).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"),
    )
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _largest(df):
    """Rows in the largest partition, of all columns (an aggregate on top would prune them and shrink the shuffle)."""
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect(), default=0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", ["with a group", "without a group"])
def test_join_groups_equals_plain_join_and_splits(skewed, how, hot):
    groups = skewed.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.where("k = 0 or k % 5 = 2" if hot == "with a group" else "k % 5 = 2").withColumnRenamed("k", "gk")
    plain = skewed.join(groups, skewed["k"] == groups["gk"], how).drop("gk")
    got = join_groups(skewed, groups, [("k", "gk")], how, shuffle=True)
    assert got.columns == plain.columns
    marks = [F.count(F.lit(1)), F.sum(F.xxhash64(*plain.columns).cast("decimal(38,0)"))]
    assert got.agg(*marks).first() == plain.agg(*marks).first()
    assert _largest(got) < 30_000  # the hot key has 50,000 rows, NULL 25,000 beside each partition's own


def test_duplicate_members_split(skewed):
    members = D.duplicate_members(skewed, ["k"], shuffle=True)
    assert members.count() == 50_000 and members.select("group_size").distinct().collect()[0][0] == 50_000
    assert _largest(members) < 30_000
    with_nulls = D.duplicate_members(skewed, ["k"], ignore_null=False, shuffle=True)
    assert with_nulls.count() == 75_000 and _largest(with_nulls) < 40_000


@pytest.mark.parametrize("allow_null", [True, False])
def test_orphans_of_a_large_parent(spark, skewed, allow_null):
    parent = spark.range(0, N, 2).select(F.col("id").alias("k"))  # 0, the hot key, has a parent
    small = R.orphans(skewed, "k", parent, "k", allow_null)
    large = R.orphans(skewed, "k", parent, "k", allow_null, broadcast_limit=0)
    assert small.metadata["plan"] != large.metadata["plan"] and small.summary.columns == large.summary.columns
    want = skewed.where(("k is null or " if not allow_null else "") + "k % 2 = 1").count()
    for out in (small, large):
        assert out.summary.first()[0] == want and out.violations.count() == want
    assert large.violations.exceptAll(small.violations).isEmpty()


def test_multi_parent_and_quality_of_a_large_parent(spark, skewed):
    parent = spark.range(0, N, 2).select(F.col("id").alias("k"))
    links = [("k", parent, "k"), ("id", parent, "k")]
    small, large = (R.multi_parent_orphans(skewed, links, broadcast_limit=b).violations for b in (10**6, 0))
    assert small.count() == large.count() == skewed.where("id % 2 = 1 or k % 2 = 1").count()
    for limit in (10**6, 0):
        flagged = G.with_match_flag(skewed, "k", parent, "k", "ok", broadcast_limit=limit)
        assert flagged.count() == N and flagged.where("ok").count() == skewed.where("k is null or k % 2 = 0").count()


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (2, 9, "c")], "k long, group_size long, n string")
    got = D.duplicate_members(df, ["k"])
    assert got.columns == ["k", "group_size", "n", "group_size_"]
    assert sorted(map(tuple, got.collect())) == [(1, 7, "a", 2), (1, 8, "b", 2)]


def test_long_keys_are_bounded_and_exact(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "y"), (4, "x" * 127), (5, "x" * 127), (6, None)], "id long, t string")
    assert sorted(r["id"] for r in D.duplicate_members(df, ["t"], shuffle=True).collect()) == [1, 2, 4, 5]
    out = D.duplicates(df, ["t"])
    assert out.summary.first()["group_count"] == 2
    assert sorted(len(r["t"]) for r in out.extras["groups"](10).collect()) == [127, 5000]
    plan = D.duplicate_groups(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_quality_score_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k long")
    row = G.quality_score("t", empty, F.col("k") > 1).first()
    assert (row["total_records"], row["records_with_issues"], row["quality_score"]) == (0, 0, None)


def test_fuzzy_pair_count_is_exact_beyond_doubles(spark):
    blocks = spark.createDataFrame([(300_000_002,)], "block_size long")
    n = F.col("block_size").cast("decimal(19,0)")
    assert int(blocks.agg((F.sum((n * (n - 1)).cast("decimal(38,0)")) / 2).cast("bigint")).first()[0]) == 45000000450000001


def test_building_checks_starts_no_job(spark):
    # a task that would fail shows that nothing ran
    broken = spark.range(1).select(F.raise_error(F.lit("ran")).cast("long").alias("k"))
    R.orphans(broken, "k", broken, "k")
    R.multi_parent_orphans(broken, [("k", broken, "k")])
    D.duplicates(broken, ["k"])
    D.fuzzy_duplicates(broken.withColumn("n", F.col("k").cast("string")), "k", ["n"])
