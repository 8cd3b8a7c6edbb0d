"""Algebraic properties between checks, on the sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from sieve.operators import duplicates as D
from sieve.operators import outliers as O
from sieve.operators import ranges as N
from sieve.operators import referential as R
from sieve.plans.fused import fused_counts
from sieve.operators import patterns as PT
from sieve.operators import completeness as C
from sieve.sources.tables import read_tables

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    return read_tables(spark, SF_SMALL, ["lineitem", "orders", "customer", "events"])


def cnt(o):
    return o.summary.first()["violation_count"]


def test_inclusive_subset_of_exclusive(t):
    ev = t["events"]
    inc = N.value_range(ev, "value", 1, 300).violations.select("event_id")
    exc = N.value_range(ev, "value", 1, 300, inclusive=False).violations.select("event_id")
    assert inc.subtract(exc).count() == 0
    assert inc.count() <= exc.count()


def test_high_union_low_is_both(t):
    ev = t["events"]
    ids = lambda d: {r["event_id"] for r in O.zscore(ev, "value", 2, d).violations.select("event_id").collect()}
    assert ids("high") | ids("low") == ids("both")
    assert not ids("high") & ids("low")


def test_duplicate_identities(t):
    li = t["lineitem"]
    out = D.duplicates(li, ["l_orderkey", "l_linenumber"])
    s = out.summary.first()
    groups = D.duplicate_groups(li, ["l_orderkey", "l_linenumber"])
    assert groups.agg(F.sum(F.col("duplicate_count") - 1)).first()[0] == s["violation_count"]
    assert out.violations.count() - s["group_count"] == s["violation_count"]
    assert groups.count() == s["group_count"]


def test_orphans_plus_matched_is_all(t):
    o, c = t["orders"], t["customer"].filter(F.col("c_acctbal") > 0)
    orphans = R.orphans(o, "o_custkey", c, "c_custkey").violations.count()
    matched = o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").count()
    assert orphans + matched == o.filter(F.col("o_custkey").isNotNull()).count()


def test_fused_equals_separate(t):
    li = t["lineitem"]
    checks = {
        "q": N.value_range(li, "l_quantity", 1, 45),
        "d": N.value_range(li, "l_discount", 0, 0.05),
        "p": PT.pattern(li, "l_returnflag", "^[AR]$"),
        "c": C.completeness(li, ["l_linestatus"]),
    }
    fused = fused_counts(li, checks).first().asDict()
    assert fused == {k: v.violations.count() for k, v in checks.items()}


def test_fuzzy_pair_count_closed_form(spark):
    df = spark.createDataFrame([(1, "Robert", "x"), (2, "Rupert", "x"), (3, "Rubert", "x"), (4, "Ann", "x"),
                                (5, "Robert", "y")], "id long, name string, g string")
    out = D.fuzzy_duplicates(df, "id", ["name"], ["g"])
    s = out.summary.first()
    assert s["violation_count"] == 3 and s["block_count"] == 1 and s["largest_block"] == 3
    assert sorted((r["anchor_id"], r["match_id"]) for r in out.violations.collect()) == [(1, 2), (1, 3)]
