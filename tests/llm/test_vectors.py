"""Exact and approximate search against brute force, with copies, ties, nulls and too few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.llm import ann as A
from sieve.llm import topk as T

from conftest import SF_ORACLE

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN, INF = float("nan"), float("inf")


def table(spark, n=700, dim=8, seed=0):
    """Random vectors, a third of them copies of one; rows that take no part; a row repeated."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).round(2)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [1.0, None] * (dim // 2)), (n + 2, [NAN] * dim), (n + 3, [INF] + [0.0] * (dim - 1)), (n + 4, []),
             (None, x[1].tolist()), rows[5], rows[100], (n + 5, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(4)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    return df, good


def brute(good, every, k, value):
    out = []
    for q in sorted(i for i in good if i % every == 0):
        found = sorted((-value(good[q], v), i) for i, v in good.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_exact_topk(spark):
    df, good = table(spark)
    whole = {i: np.floor(1024 * v) for i, v in good.items()}
    assert rows_of(T.scaled_topk(df, k=10, every=20)) == brute(whole, 20, 10, lambda a, b: int(a @ b))


def test_exact_topk_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(T, "ROW_TILE", 64)
    monkeypatch.setattr(T, "QUERY_TILE", 4)
    monkeypatch.setattr(T, "STEP", 8)
    df, good = table(spark, seed=3)
    whole = {i: np.floor(1024 * v) for i, v in good.items()}
    assert rows_of(T.scaled_topk(df, k=5, every=50)) == brute(whole, 50, 5, lambda a, b: int(a @ b))


def test_pivots_drop_most_rows_of_clustered_vectors():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(-500, 500, (20, 8)), 100, axis=0) + rng.integers(-3, 4, (2000, 8)).astype(float)
    top = (x * x).sum(1).max()
    pivots = T.pick_pivots(T.lifted(x, top), 20)
    d = T.distances(T.lifted(x, top), pivots)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1 and self.ndim == 2:
                seen.append(len(key))
            return np.asarray(self)[key]

    hits = T.search_tile(x[:1], [0], np.array([-np.inf]), x.view(Counted), d, [[i] for i in range(2000)], pivots, top, 10)
    best = sorted((-int(x[0] @ x[i]), i) for i in range(1, 2000))[:10]
    assert sorted((-s, v) for _, v, s in hits) == best and sum(seen) < 1000


@pytest.mark.parametrize("search", ["exact", "near"])
def test_few_and_no_rows(spark, search):
    df, _ = table(spark)
    run = (lambda d: T.scaled_topk(d, 10, every=2)) if search == "exact" else (lambda d: A.nearest_embeddings(d, 10, every=2))
    assert run(df.where("vec_id < 0")).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (2, [1.0, 1.0], ""), (3, [2.0, 1.0], ""), (4, [1.0, 2.0, 3.0], "")], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in run(few).collect())
    assert got == [(0, 1, 3), (0, 2, 2), (2, 1, 0), (2, 2, 3)]  # ties go to the smaller id; 4 has no row of its length


def test_near_with_all_buckets_is_exact(spark):
    df, good = table(spark, dim=8)
    good = {i: v for i, v in good.items() if v.any()}
    rows = df.where(A.finite("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    wide = A.Hashing(tables=2, projections=2, width=8.0, probes=9)
    got = rows_of(A.nearest(rows, rows.where("id % 50 = 0").dropDuplicates(["id"]), 7, wide))
    want = brute(good, 50, 7, lambda a, b: float((a * b).sum()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_queries_that_find_too_few_see_all_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "ROW_TILE", 100)
    df, good = table(spark)
    good = {i: v for i, v in good.items() if v.any()}
    rows = df.where(A.finite("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    narrow = A.Hashing(tables=1, projections=8, width=0.05, probes=1)
    got = rows_of(A.nearest(rows, rows.where("id % 100 = 1").dropDuplicates(["id"]), 7, narrow))
    want = brute({i: v for i, v in good.items()}, 1, 7, lambda a, b: float((a * b).sum()))
    want = [w[:3] for w in want if w[0] % 100 == 1]
    assert [g[:3] for g in got] == want


def test_more_ties_than_a_tile_keeps_go_to_the_smaller_ids(spark):
    """9,000 distinct vectors with one inner product, and 3 that are ahead."""
    rng = np.random.default_rng(4)
    x = np.c_[np.full(9000, 0.5), rng.permutation(9000) / 9000]
    x[[10, 4000, 8999], 0] = 0.75
    ids = rng.permutation(9000)
    got = A.score_tiles(np.array([[1.0, 0.0], [-1.0, 0.0]]), [-1, -2], x, [[int(i)] for i in ids], 20)
    ahead = sorted(ids[[10, 4000, 8999]].tolist())
    tied = sorted(set(ids.tolist()) - set(ahead))
    assert [(v, s) for q, v, s in got if q == -1] == [(v, 0.75) for v in ahead] + [(v, 0.5) for v in tied[:17]]
    assert [(v, s) for q, v, s in got if q == -2] == [(v, -0.5) for v in tied[:20]]
    rows = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "id long, vec array<double>").coalesce(3)
    asked = spark.createDataFrame([(-1, [1.0, 0.0])], "id long, vec array<double>")
    every = A.nearest(rows, asked, 20, A.Hashing(tables=1, projections=8, width=0.01, probes=1)).orderBy("rank").collect()  # by the short-query path
    assert [(r["vec_id"], r["score"]) for r in every] == [(v, 0.75) for v in ahead] + [(v, 0.5) for v in tied[:17]]


def test_moves_come_in_the_order_of_their_cost():
    inside = np.array([0.1, 0.45, 0.8])
    found = A.moves(inside, 27)
    assert len({tuple(m) for m in found}) == 27 and not found[0].any()
    cost = [sum((x if m == -1 else 1 - x) ** 2 for x, m in zip(inside, f, strict=True) if m) for f in found]
    assert cost == sorted(cost)
    rows = np.random.default_rng(3).random((20, 4))
    assert A.offsets(rows, 30).tolist() == [[m.tolist() for m in A.moves(r, 30)] for r in rows]
    assert A.offsets(rows[:, :1], 9).shape == (20, 3, 1) and A.offsets(np.empty((0, 4)), 5).shape == (0, 5, 4)
    assert A.offsets(np.tile(rows, 2), 7).shape == (20, 7, 8)


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in A.nearest_embeddings(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
        assert len(found[ids[q]]) == 20
    assert np.mean(hits) >= 0.9


def test_tiles_no_query_reaches_get_no_vectors(spark, monkeypatch):
    """Clustered vectors: pairs of tiles are dropped by their pivot intervals before vectors are attached."""
    monkeypatch.setattr(T, "ROW_TILE", 50)
    monkeypatch.setattr(T, "QUERY_TILE", 4)
    monkeypatch.setattr(T, "DIRECTORY", 8)
    written = {}
    plain = T.stage
    monkeypatch.setattr(T, "stage", lambda df, name: written.setdefault(name, plain(df, name)))
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((16, 12)), 120, axis=0) + 0.01 * rng.standard_normal((1920, 12))
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x.astype(np.float32).astype(float))], SCHEMA)
    good = {i: np.floor(1024 * np.float32(v).astype(float)) for i, v in enumerate(x)}
    assert rows_of(T.scaled_topk(df, k=5, every=40)) == brute(good, 40, 5, lambda a, b: int(a @ b))
    rows, queries, pairs = (written[n].count() for n in ("row-tiles", "query-tiles", "reached-tiles"))
    assert rows > 30 and queries > 10 and pairs < 0.5 * rows * queries


@pytest.mark.parametrize("kind", ["clustered", "uneven", "very uneven", "outlier"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(6)
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((30, 32)), 40, axis=0) + 0.3 * rng.standard_normal((1200, 32))
    elif kind == "outlier":
        x = rng.standard_normal((1200, 32))
        x[7] *= 1e4
    else:
        x = rng.standard_normal((1200, 32)) * np.exp((0.3 if kind == "uneven" else 1.0) * rng.standard_normal(1200))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = {}
    for r in A.nearest(rows, rows.where("id % 30 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in range(0, 1200, 30):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(hits) >= (0.99 if kind == "clustered" else 0.9) - 1e-12  # a mean of shares rounds


def candidates(x, q, hashing, tops):
    """(queries, rows): whether a query meets a row in any table."""
    cells = hashing.row_cells(x, tops)
    return np.array([np.isin(cells, own).any(1) for own in hashing.query_cells(q, len(tops))])


@pytest.mark.parametrize("kind", ["clustered", "even", "uneven"])
def test_fitted_parameters_prune(kind):
    """Held-out recall over all rows, the share of rows that are candidates, and probes that are a choice among the moves."""
    rng = np.random.default_rng(8)
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((150, 32)), 40, axis=0) + 0.3 * rng.standard_normal((6000, 32))
    else:
        x = rng.standard_normal((6000, 64))
        x *= (1 if kind == "even" else np.exp(0.5 * rng.standard_normal(6000))[:, None]) / np.sqrt((x * x).sum(1))[:, None]
    norm = np.sqrt((x * x).sum(1))
    tops = A.band_tops(norm.max(), np.quantile(norm, A.BANDS).tolist())
    assert (len(tops) == 1) == (kind == "even")
    order = rng.permutation(6000)
    hashing = A.fitted(x[order[:A.SAMPLE]], x[order[:A.ASKED]], 6000, 300, tops, 20)
    assert hashing.probes < 3 ** hashing.projections
    asked = order[-60:]
    met, score = candidates(x, x[asked], hashing, tops), x[asked] @ x.T
    score[np.arange(60), asked] = -np.inf
    near = np.argsort(-score, axis=1)[:, :20]
    assert np.take_along_axis(met, near, 1).mean() >= 0.9
    assert met.mean() < (0.5 if kind == "clustered" else 0.97)


def test_more_rows_take_more_projections():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((A.SAMPLE, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    few, many = (A.fitted(x, x[:A.ASKED], n, n // 20, [1.0], 20) for n in (2000, 10**9))
    assert many.projections > few.projections


def test_success_order_beats_any_other(spark):
    """As many probes in the order of success find more neighbours than the last ones of that order."""
    rng = np.random.default_rng(10)
    x = np.repeat(rng.standard_normal((100, 32)), 20, axis=0) + 0.5 * rng.standard_normal((2000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    hashing = A.Hashing(1, 6, 0.9, 60)
    values = hashing.values(np.c_[x, np.zeros(2000)])[:, 0]
    buckets = np.floor(values)
    first = last = 0
    for q in range(0, 2000, 50):
        every = A.moves(values[q] - buckets[q], 3 ** 6)
        near = {tuple(b) for b in (buckets[np.argsort(-(x @ x[q]))[1:20]] - buckets[q]).astype(int).tolist()}
        first += len(near & {tuple(m.tolist()) for m in every[:60]})
        last += len(near & {tuple(m.tolist()) for m in every[-60:]})
    assert first > 3 * last


def test_double_precision_is_kept(spark):
    """Vectors that single precision cannot hold are scored as they are."""
    x = [[0.1, 0.2], [1 / 3, 0.7], [0.1 + 1e-12, 0.2], [0.5, 0.1]]
    rows = spark.createDataFrame(list(enumerate(x)), "id long, vec array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in A.nearest(rows, rows, 3).collect()}
    assert got == {(a, b): x[a][0] * x[b][0] + x[a][1] * x[b][1] for a in range(4) for b in range(4) if a != b}
