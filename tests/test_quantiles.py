"""Exact order statistics: single-pass path and the bracket search agree with numpy."""

import math

import numpy as np
import pytest

from sieve.operators import quantiles as Q


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.normal(100, 15, 20000), rng.integers(0, 50, 5000).astype(float),
                           rng.exponential(30, 5000)])
    df = spark.createDataFrame([(float(x),) for x in data], "x double").repartition(6)
    return Q.clean_values(df, "x"), np.sort(data)


@pytest.mark.parametrize("limit", [10_000_000, 500])  # fast path / forced bracket search
def test_order_statistics(values, limit):
    vals, ref = values
    n = len(ref)
    ranks = [0, 1, n // 4, n // 2, (3 * n) // 4, n - 2, n - 1]
    got = Q.order_statistics(vals, ranks, distinct_limit=limit, accuracy=200)
    assert got == {r: float(ref[r]) for r in ranks}


@pytest.mark.parametrize("limit", [10_000_000, 500])
def test_quantiles_match_numpy(values, limit):
    vals, ref = values
    probs = [0.25, 0.5, 0.75]
    cont, n = Q.quantiles_cont(vals, probs, distinct_limit=limit, accuracy=200)
    assert n == len(ref)
    for p, q in zip(probs, cont):
        assert q == pytest.approx(float(np.quantile(ref, p, method="linear")), rel=1e-12)
    rank, _ = Q.quantiles_rank(vals, probs, distinct_limit=limit, accuracy=200)
    assert rank == [float(ref[int(math.floor(p * n))]) for p in probs]


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8, 12])
def test_rank_indexes(spark, n):
    xs = [float(i * i) for i in range(n)]
    vals = Q.clean_values(spark.createDataFrame([(x,) for x in xs], "x double"), "x")
    got, _ = Q.quantiles_rank(vals, [0.25, 0.5, 0.75])
    assert got == [xs[n // 4], xs[n // 2], xs[(3 * n) // 4]]


def test_heavy_ties_bracket(spark):
    xs = [1.0] * 3000 + [2.0] * 10 + [3.0] * 3000
    vals = Q.clean_values(spark.createDataFrame([(x,) for x in xs], "x double"), "x")
    got = Q.order_statistics(vals, [0, 2999, 3000, 3005, 3010, 6009], distinct_limit=1, accuracy=100)
    assert got == {0: 1.0, 2999: 1.0, 3000: 2.0, 3005: 2.0, 3010: 3.0, 6009: 3.0}
