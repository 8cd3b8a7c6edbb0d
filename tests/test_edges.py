"""Edge rows not covered by the reference tests (FIXTURES.md section 2)."""

import math

import pytest
from pyspark.sql import types as T

from sieve.functions.patterns import NAMED_PATTERNS
from sieve.operators import completeness as C
from sieve.operators import duplicates as D
from sieve.operators import outliers as O
from sieve.operators import patterns as PT
from sieve.operators import ranges as N
from sieve.operators import referential as R


def n(outcome):
    return outcome.summary.first()["violation_count"]


@pytest.fixture(scope="module")
def blanks(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType()),
                           T.StructField("i", T.LongType())])
    return spark.createDataFrame(
        [(1, "", 0), (2, "   ", 1), (3, "\t", 2), (4, "ok", 3), (5, None, None)], schema)


def test_empty_and_whitespace(blanks):
    assert n(C.completeness(blanks, ["s"], check_empty_strings=False)) == 1
    assert n(C.completeness(blanks, ["s"])) == 2
    # spaces only are blank; a tab is not trimmed
    assert n(C.completeness(blanks, ["s"], check_whitespace=True)) == 3


def test_empty_string_check_skips_numbers(blanks):
    # 0 in an integer column is never "empty"
    assert n(C.completeness(blanks, ["i"])) == 1


def test_first_missing_and_profile(blanks):
    rows = C.first_missing_field(blanks, ["s", "i"], keep=["id"]).collect()
    assert [(r["id"], r["missing_field"]) for r in rows] == [(5, "s")]
    prof = {r["column_name"]: r for r in C.completeness_profile(blanks, ["s", "i"], True).collect()}
    assert prof["s"]["null_count"] == 2 and prof["i"]["null_count"] == 1
    assert prof["s"]["null_percentage"] == 40.0 and prof["s"]["total_records"] == 5


@pytest.fixture(scope="module")
def fk(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 30), (4, 99)], "id long, k long")
    parent = spark.createDataFrame([(10,), (None,), (30,)], "k long")
    return child, parent


def test_allow_null(fk):
    child, parent = fk
    assert n(R.orphans(child, "k", parent, "k")) == 1
    assert n(R.orphans(child, "k", parent, "k", allow_null=False)) == 2


def test_multi_parent(spark, fk):
    child = spark.createDataFrame([(1, 10, 1), (2, None, 9), (3, 77, None), (4, None, None)],
                                  "id long, a long, b long")
    pa = spark.createDataFrame([(10,), (10,)], "k long")  # duplicate parent keys never multiply rows
    pb = spark.createDataFrame([(1,)], "k long")
    out = R.multi_parent_orphans(child, [("a", pa, "k"), ("b", pb, "k")])
    assert sorted(r["id"] for r in out.violations.collect()) == [2, 3]


def test_case_insensitive_and_nulls(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, "ANN"), (3, None), (4, None), (5, "bob")], "id long, name string")
    assert n(D.duplicates(df, ["name"])) == 0
    assert n(D.duplicates(df, ["name"], case_sensitive=False)) == 1
    g = D.duplicate_groups(df, ["name"], case_sensitive=False).first()
    assert g["name"] == "ANN" and g["duplicate_count"] == 2  # smallest spelling represents the group
    assert n(D.duplicates(df, ["name"], ignore_null=False)) == 1
    members = D.duplicate_members(df, ["name"], ignore_null=False).collect()
    assert sorted(r["id"] for r in members) == [3, 4]  # NULL group found by the null-safe join-back


def test_range_bounds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (11.0,), (None,), (float("nan"),)], "x double")
    assert n(N.value_range(df, "x", 1, 10)) == 2
    assert n(N.value_range(df, "x", 1, 10, inclusive=False)) == 4
    assert n(N.value_range(df, "x", min_value=1)) == 1
    assert n(N.value_range(df, "x", max_value=10)) == 1
    with pytest.raises(ValueError):
        N.value_range(df, "x")


def test_dates_and_cross_field(spark):
    df = spark.createDataFrame([("2020-01-01", "2020-02-01"), ("2020-03-01", "2020-02-01"), (None, "2020-01-01")],
                               "s string, e string").selectExpr("CAST(s AS DATE) s", "CAST(e AS DATE) e")
    assert n(N.cross_field(df, "e", ">=", "s")) == 1
    assert n(N.date_range(df, "s", "2020-01-15", "2020-02-15")) == 2
    assert n(N.future_dates(df, "e", "2020-01-15")) == 2


def test_patterns(spark):
    df = spark.createDataFrame([("abc",), ("x1",), (None,)], "v string")
    assert n(PT.pattern(df, "v", "[0-9]")) == 1            # unanchored: find semantics
    assert n(PT.pattern(df, "v", "[0-9]", inverse=True)) == 1
    assert n(PT.pattern(df, "v", "[0-9]", match_null=False)) == 2
    assert n(PT.like(df, "v", "a%")) == 1


GOOD_BAD = {
    "email": ("a.b@example.com", "a@b"),
    "us_phone": ("(555) 123-4567", "555-1234"),
    "us_zip": ("12345-6789", "1234"),
    "ca_postal": ("R3A 1B2", "R3A-1B"),
    "ssn": ("123-45-6789", "12-345-6789"),
    "url": ("https://example.com/x", "ftp://example.com"),
    "ipv4": ("10.0.0.1", "10.0.1"),
    "date_iso": ("2024-01-31", "2024/01/31"),
    "uuid": ("123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456"),
}


def test_named_patterns(spark):
    assert set(GOOD_BAD) == set(NAMED_PATTERNS)
    rows = [(name, v, ok) for name, (good, bad) in GOOD_BAD.items() for v, ok in ((good, True), (bad, False))]
    df = spark.createDataFrame(rows, "name string, v string, ok boolean")
    for name in GOOD_BAD:
        sub = df.filter(df.name == name)
        bad = {r["v"] for r in PT.pattern(sub, "v", name).violations.collect()}
        assert bad == {GOOD_BAD[name][1]}, name


def test_outlier_guards(spark):
    const = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    assert n(O.zscore(const, "x")) == 0 and "note" in O.zscore(const, "x").metadata
    assert n(O.iqr(const, "x")) == 0
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    assert n(O.zscore(empty, "x")) == 0 and n(O.iqr(empty, "x")) == 0
    single = spark.createDataFrame([(5.0,)], "x double")
    assert n(O.zscore(single, "x")) == 0
    three = spark.createDataFrame([(1.0,), (2.0,), (100.0,)], "x double")
    assert "Insufficient" in O.iqr(three, "x", quartiles="rank").metadata["note"]
    with pytest.raises(ValueError):
        O.zscore(three, "x", direction="sideways")


def test_iqr_rank_n4(spark):
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (50.0,)], "x double")
    m = O.iqr(four, "x", quartiles="rank").metadata
    assert (m["q1"], m["median"], m["q3"]) == (2.0, 3.0, 50.0)


def test_nan_is_ignored(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double")
    m = O.zscore(df, "x", 0.5).metadata
    assert not math.isnan(m["mean"]) and m["n"] == 3


def test_orphans_both_plans_agree(spark, fk):
    child, parent = fk
    for allow_null in (True, False):
        small = R.orphans(child, "k", parent, "k", allow_null=allow_null)
        large = R.orphans(child, "k", parent, "k", allow_null=allow_null, broadcast_limit=0)
        assert small.metadata["plan"] != large.metadata["plan"]
        ids = lambda o: sorted(r["id"] for r in o.violations.collect())
        assert ids(small) == ids(large)
        assert n(small) == n(large)
        vals = lambda o: [r["orphan_value"] for r in o.extras["orphan_values"](20).collect()]
        assert vals(small) == vals(large)
