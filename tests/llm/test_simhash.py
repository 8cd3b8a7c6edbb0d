"""Fingerprints, ball links and components against brute force."""

import numpy as np
import pytest
import xxhash
from llm_data import ROWS, awkward, empty
from pyspark.sql import functions as F

from sieve.llm import components as C
from sieve.llm import simhash as S


def fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, bits):
    """Component of each distinct value, by the smallest value in it."""
    values = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return dict(zip(values.tolist(), label.tolist(), strict=True))
        label = new


def test_fingerprints_and_components(spark):
    got = S.simhash_components(awkward(spark)).collect()
    marks = [(r[0], fingerprint(r[1])) for r in ROWS]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{m:016x}") for d, m in marks)
    label = roots([m for _, m in marks], 4)
    smallest = {}
    for d, m in marks:
        if d is not None:
            smallest[label[m]] = min(d, smallest.get(label[m], d))
    assert all(r["component_id"] == smallest.get(label[int(r["fingerprint"], 16)]) for r in got)
    assert S.simhash_components(empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [2, 4])
def test_links_connect_what_brute_force_connects(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = [0, 2**64 - 1]
    for b in base:
        v = b
        for _ in range(12):  # a chain: each step within or just beyond the distance
            for k in rng.choice(64, rng.integers(1, bits + 2), replace=False):
                v ^= np.uint64(1) << np.uint64(k)
            values.append(int(v))
    values = np.unique(np.array(values, np.uint64))
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = S.ball_links(points, len(values), bits)
    pairs = np.array([(r["a"], r["b"]) for r in links.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    assert set(pairs.ravel().tolist()) <= set(values.tolist())
    label = {int(r["node"]): int(r["root"]) for r in C.components(links).collect()}
    want = roots(values, bits)
    mine = {int(v): label.get(int(s), int(s)) for v, s in zip(values, values.view(np.int64), strict=True)}
    together = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert together(mine) == together(want)


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        S.ball_links(spark.createDataFrame([(1,)], "fp long"), 1, 3)


def test_ball_and_cells():
    masks = S.ball(2)
    assert len(masks) == 2081 == len(set(masks.tolist()))
    table = S.cell_table(9)
    words = np.random.default_rng(0).integers(0, 2**63, 100, dtype=np.uint64)
    assert (S.cells_of(words ^ masks[77], table) == S.cells_of(words, table) ^ S.cells_of(masks[77:78], table)).all()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(10, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = spark.createDataFrame(chain + star + [(5, 5), (2000, 1999)], "a long, b long")
    got = {r["node"]: r["root"] for r in C.components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 201)}, **{1000 + i: 1000 for i in range(300)}, 1999: 1999, 2000: 1999}
    assert C.components(links.where("a < 0")).collect() == []


def test_drop_near_duplicates_keeps_one_of_each(spark):
    docs = awkward(spark)
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    label = roots([fingerprint(r[1]) for r in ROWS], 4)
    kept = sorted(label[fingerprint(r["text"])] for r in got.collect())
    assert kept == sorted({label[fingerprint(r[1])] for r in ROWS})  # no group lost, none twice
    assert got.where(F.col("doc_id") == 2).count() == 0 and got.where(F.col("doc_id") == 1).count() == 1
    assert S.drop_near_duplicates(empty(spark)).collect() == []


def test_rows_are_told_apart_by_number(spark):
    # The same values in other columns: a hash that skips nulls would be the same.
    rows = [(5, "some text that stands alone here", None), (5, None, "some text that stands alone here"), (5, None, "some text that stands alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, S.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted(rows[:2], key=str)


def test_cells_stay_bounded_at_any_size():
    for rows in (1, 10_000, 10**7, 5 * 10**10):
        passes, cells = S.bits_for(rows * 2081)
        assert passes >= 3 and cells <= 16 and rows * 2081 / 2 ** (passes + cells) <= 2 * S.CELL_VARIANTS


def test_more_passes_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(S, "bits_for", lambda variants: (5, 4))
    values = np.random.default_rng(4).integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.r_[values, values ^ np.uint64(9), values ^ np.uint64(0xF0)])
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = {int(r["node"]): int(r["root"]) for r in C.components(S.ball_links(points, len(values))).collect()}
    want = roots(values, 4)
    signed = values.view(np.int64).tolist()
    groups = lambda of: sorted(sorted(k for k, v in of.items() if v == x) for x in set(of.values()))
    assert groups({int(v): label.get(s, s) for v, s in zip(values, signed, strict=True)}) == groups(want)
