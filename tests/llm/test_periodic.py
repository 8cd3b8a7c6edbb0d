"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import LONG, ROWS, awkward, empty, words
from pyspark.sql import functions as F

from sieve.llm import periodic as P


def brute_runs(w, least=24, times=3):
    found, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            piece = w[i:i + length]
            if length >= max(least, times * q) and not any(all(piece[k] == piece[k + p] for k in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


def brute_row(doc_id, text):
    w = [x.decode() for x in words(text)]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_word_runs_equal_brute_force(parts):
    w = list("".join(root * times for root, times in parts))
    assert P.word_runs(w) == brute_runs(w)
    assert P.word_runs(w, 2, 2) == brute_runs(w, 2, 2)


def test_stretches_hold_every_run():
    rng = random.Random(3)
    for _ in range(60):
        w = []
        while len(w) < 300:
            root = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
            w += root * rng.randint(1, 6) + [f"x{len(w)}"] * rng.randint(0, 2)
        sizes = [100, 0, len(w) - 100]
        marks = P.np.array([zlib.crc32(x.encode()) for x in w])
        for begin, size in ((0, 100), (100, len(w) - 100)):
            for s, n, _ in brute_runs(w[begin:begin + size]):
                assert any(a <= begin + s and begin + s + n <= b for a, b in P.repeated_stretches(marks, P.np.array(sizes)))


def test_awkward_rows_and_the_empty_table(spark):
    short = awkward(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    assert rows(P.periodic_documents(short)) == sorted((brute_row(r[0], r[1]) for r in ROWS if r[1] != LONG), key=str)
    assert len(P.periodic_documents(awkward(spark)).collect()) == len(ROWS)
    assert P.periodic_documents(empty(spark)).collect() == []


def test_a_long_periodic_text_and_batches(spark):
    root = [f"w{i}" for i in range(700)]
    text = " ".join([*"abc", *(root * 40), "end"])
    docs = spark.createDataFrame([(None, text), (None, "x " * 30_000), (None, " ".join("ab" * 12 + "c"))], "doc_id long, text string")
    got = {tuple(map(tuple, r["runs"])): r["collapsed"] for r in P.text_runs(docs).collect()}
    assert got == {((3, 28_000, 700),): " ".join([*"abc", *root, "end"]), ((0, 30_000, 1),): "x", ((0, 24, 2),): "a b c"}


def test_ties_go_to_the_smallest_start_then_period(spark):
    data = [([(0, 24, 8), (40, 30, 10), (40, 27, 9)],), ([],), ([(0, 25, 8), (40, 49, 16), (99, 100, 32)],)]
    df = spark.createDataFrame(data, f"runs {P.RUNS}")
    got = [r["b"] and tuple(r["b"]) for r in df.select(P.strongest(F.col("runs")).alias("b")).collect()]
    assert got == [(0, 24, 8), None, (0, 25, 8)]


def test_the_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given_rows = [r for r in docs.select("doc_id", "text").collect() if len(words(r["text"])) < 800]
    ids = [r["doc_id"] for r in given_rows]
    got = rows(P.periodic_documents(docs).where(F.col("doc_id").isin(ids)))
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in given_rows), key=str)
    assert any(r[1] for r in got)


def test_limits_that_the_search_relies_on(spark):
    with pytest.raises(ValueError):
        P.text_runs(empty(spark), times=2)
