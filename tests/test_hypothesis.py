"""Property tests on generated data (few examples: every example runs Spark jobs)."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sieve.operators import duplicates as D
from sieve.operators import quantiles as Q
from sieve.operators import ranges as N

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float)), min_size=1, max_size=40)


@SETTINGS
@given(xs=values, lo=st.integers(-10, 0), hi=st.integers(1, 10))
def test_inclusive_violations_within_exclusive(spark, xs, lo, hi):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")
    inc = {r["id"] for r in N.value_range(df, "x", lo, hi).violations.collect()}
    exc = {r["id"] for r in N.value_range(df, "x", lo, hi, inclusive=False).violations.collect()}
    assert inc <= exc
    assert inc == {i for i, x in enumerate(xs) if x is not None and (x < lo or x > hi)}


@SETTINGS
@given(xs=st.lists(st.integers(-5, 5).map(float), min_size=4, max_size=60),
       limit=st.sampled_from([1, 3, 10_000]))
def test_order_statistics_match_sorting(spark, xs, limit):
    vals = Q.clean_values(spark.createDataFrame([(x,) for x in xs], "x double"), "x")
    ref = sorted(xs)
    n = len(ref)
    ranks = sorted({0, n // 4, n // 2, (3 * n) // 4, n - 1})
    assert Q.order_statistics(vals, ranks, distinct_limit=limit, accuracy=100) == {r: ref[r] for r in ranks}
    cont, _ = Q.quantiles_cont(vals, [0.25, 0.5, 0.75], distinct_limit=limit, accuracy=100)
    for p, q in zip([0.25, 0.5, 0.75], cont):
        assert math.isclose(q, float(np.quantile(ref, p)), rel_tol=1e-12, abs_tol=1e-12)


@SETTINGS
@given(keys=st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 2)), min_size=1, max_size=40),
       ignore_null=st.booleans())
def test_duplicate_identities(spark, keys, ignore_null):
    df = spark.createDataFrame([(i, k, j) for i, (k, j) in enumerate(keys)], "id long, k string, j long")
    out = D.duplicates(df, ["k", "j"], ignore_null=ignore_null)
    s = out.summary.first()
    counts = {}
    for k, j in keys:
        if ignore_null and k is None:
            continue
        counts[(k, j)] = counts.get((k, j), 0) + 1
    dup = [c for c in counts.values() if c > 1]
    assert s["violation_count"] == sum(c - 1 for c in dup)
    assert s["group_count"] == len(dup)
    assert out.violations.count() == sum(dup)
