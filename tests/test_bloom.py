"""Bloom filters before joins: nothing is lost, little else stays, and less is shuffled."""

import pytest
from pyspark.sql import functions as F
from test_skew import N, _largest, skewed  # noqa: F401 - a fixture

from sieve.operators import bloom as B
from sieve.operators import duplicates as D
from sieve.operators import referential as R
from sieve.operators.skew import join_groups
from sieve.staging import stage


def shuffled(df):
    """Bytes written to the shuffles of ``df``, which is run here; its rows."""
    rows = df.collect()

    def total(node):
        name, children = node.nodeName(), []
        if name == "AdaptiveSparkPlan":
            children = [node.executedPlan()]
        elif name.endswith("QueryStage"):
            children = [node.plan()]
        else:
            children = [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
        return own + sum(map(total, children))

    return total(df._jdf.queryExecution().executedPlan()), rows


def test_sizes_are_bounded():
    assert B.n_words(0) == 1 and B.n_words(4) == 1 and B.n_words(1000) == 250
    assert B.n_words(B.CAPACITY) == B.MAX_WORDS and B.n_words(B.CAPACITY + 1) == 0


def test_all_keys_stay_and_few_others(spark):
    rows = spark.range(0, 200_000, 1, 8).select("id", F.concat(F.lit("key "), "id").alias("t"), (F.col("id") % 7).cast("int").alias("part"))
    keys = rows.where("id % 20 = 3")
    bloom = B.key_filter(keys, ["t", "part"], 10_000)
    assert bloom.words == 2500
    kept = bloom.keep(rows, ["t", "part"])
    assert kept.columns == rows.columns
    assert kept.where("id % 20 = 3").count() == 10_000
    assert kept.count() < 10_000 + 0.01 * 190_000
    with pytest.raises(TypeError):
        bloom.keep(rows, ["id"])
    full = B.key_filter(keys, ["id"], 5_000).keep(rows, ["id"])  # as few bits a key as a filter may have
    assert full.where("id % 20 = 3").count() == 10_000 and full.count() < 10_000 + 0.06 * 190_000


def test_awkward_keys(spark):
    rows = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), ""), (None, "x"), (None, None), (1.5, "long " * 5000)], "x double, t string")
    for keep in ("x = 0", "isnan(x)", "x IS NULL AND t IS NULL", "length(t) > 99"):
        keys = rows.where(keep)
        bloom = B.key_filter(keys, ["x", "t"], keys.count())
        assert bloom.keep(rows, ["x", "t"]).where(keep).count() == keys.count() > 0
    assert B.key_filter(rows.limit(0), ["x"], 0).keep(rows, ["x"]).isEmpty()
    assert B.key_filter(rows, ["x"], 6).keep(rows.limit(0), ["x"]).isEmpty()
    assert B.key_filter(rows, ["x"], B.CAPACITY + 1) is None


@pytest.mark.parametrize("how", ["inner", "left_semi"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_join_equals_the_plain_one_and_shuffles_less(spark, how, null_safe):
    rows = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 50 != 7, F.col("id") % 40_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    groups = stage(rows.where("k % 200 = 5 OR k IS NULL").groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("n")), "groups")
    plain, filtered = (shuffled(join_groups(rows, groups, [("k", "g")], how, null_safe=null_safe, written=True, shuffle=True, prefilter=p)) for p in (False, True))
    assert sorted(plain[1]) == sorted(filtered[1]) and len(plain[1]) > 900
    assert filtered[0] < 0.2 * plain[0]


def test_keys_of_other_types_are_joined_without_a_filter(spark):
    rows = spark.range(100).select(F.col("id").cast("int").alias("k"))
    groups = spark.range(0, 100, 10).select(F.col("id").alias("g"))
    assert join_groups(rows, groups, [("k", "g")], "left_semi", shuffle=True, prefilter=True).count() == 10
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    assert R.orphan_keys(rows, "k", groups, "g", prefilter=True).count() == 90 and per_key.count() == 100


@pytest.mark.parametrize("allow_null", [True, False])
def test_orphans_of_many_parents(spark, allow_null):
    """Parents that no child refers to are not shuffled, nor are child rows that are no orphans."""
    child = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 11 != 4, F.col("id") % 3000 * 100).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    parent = spark.range(0, 400_000, 1, 8).select(F.col("id").alias("k")).where("k % 4700 <> 0")
    with_join = {p: R.orphans(child, "k", parent, "k", allow_null, broadcast_limit=0, prefilter=p) for p in (False, True)}
    listed = {p: shuffled(out.violations) for p, out in with_join.items()}
    want = child.where("k >= 400000 OR k % 4700 = 0" + ("" if allow_null else " OR k IS NULL")).count()
    assert sorted(listed[True][1], key=str) == sorted(listed[False][1], key=str) and len(listed[True][1]) == want > 0
    assert all(out.summary.first()[0] == want for out in with_join.values())
    assert listed[True][0] < 0.2 * listed[False][0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # parents as they are where they exceed a broadcast
    try:
        keys = {p: shuffled(R.orphan_keys(child, "k", parent, "k", prefilter=p)) for p in (False, True)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(keys[True][1]) == sorted(keys[False][1]) and keys[True][0] < 0.5 * keys[False][0]


def test_by_default_the_filter_answers_the_sizes(spark, monkeypatch):
    child = spark.range(1000).select((F.col("id") % 100).alias("k"))
    parent = spark.range(5, 5000).select(F.col("id").alias("k"))
    used = []
    monkeypatch.setattr(R, "referred_parents", lambda per_key, column, keys: used.append(1) or (per_key, keys))
    assert R.orphans(child, "k", parent, "k", broadcast_limit=0).violations.count() == 50 and not used
    monkeypatch.setattr(R, "FILTER_FROM", 1000)
    assert R.orphans(child, "k", parent, "k", broadcast_limit=0).violations.count() == 50 and used == [1]
    near = spark.range(5, 205).select(F.col("id").alias("k"))  # parents are but twice the child's keys
    assert R.orphan_keys(child, "k", near, "k", parent_rows=200).count() == 5 and used == [1]


def test_a_hot_key_is_still_split(skewed):  # noqa: F811
    members = D.duplicate_members(skewed, ["k"], shuffle=True, prefilter=True)
    assert members.count() == 50_000 and _largest(members) < 30_000
    gone = R.orphans(skewed, "k", skewed.sparkSession.range(1, N, 2).select(F.col("id").alias("k")), "k", broadcast_limit=0, prefilter=True)
    assert gone.violations.count() == gone.summary.first()[0] == skewed.where("k % 2 = 0").count()
    assert _largest(gone.violations) < 30_000
