"""Mixing against a plain reading of its rules: resharing in rounds, epochs, and a sorted fill of the rest."""

import hashlib
import math
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ROWS, awkward, empty, words

from sieve.llm import mixing as M


def reshared(sizes: list[int]) -> list[float]:
    """Targets by the contract's words: share by weight, stop at twice the size, share the excess again until none is above."""
    weights, targets, capped = [(3, 1, 2)[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), set()
    left = 1.5 * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in open_)
        if not open_ or left <= 0:
            return [2.0 * sizes[i] if i in capped else 0.0 for i in range(len(sizes))]
        share = {i: left * weights[i] / total for i in open_}
        above = [i for i in open_ if share[i] > 2 * sizes[i] + 1e-9]
        if not above:
            return [2.0 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= set(above)
        left -= sum(2 * sizes[i] for i in above)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1, 1], [0, 5, 0], [100, 3, 7, 50, 50, 1], [7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in M.source_targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).orderBy("source").collect()]
    assert got == pytest.approx(reshared(sizes))


def key(doc_id, text, weight=1.0, seed=11):
    name = str(doc_id) if doc_id is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
    u = (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


def test_taken_words_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * ((i * 7919) % 23)), ["hot", "b", None, "c"][(i % 7) // 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)] + [(None, 1), (3, None), (6, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in M.mix(docs, quality=labels).collect()}
    marks = defaultdict(lambda: None)
    for i in range(0, 600, 3):
        marks[i] = max(i % 2, 1 if i == 6 else 0)
    weight = {None: 1.0, 0: 0.5, 1: 2.0}
    by_source = defaultdict(list)
    for i, text, s in rows:
        by_source[s].append((key(i, text, weight[marks[i]]), i, len(words(text))))
    names = sorted((s for s in by_source if s is not None)) + [None]
    targets = dict(zip(names, reshared([sum(x[2] for x in by_source[s]) for s in names]), strict=True))
    for s, docs_ in by_source.items():
        size = sum(x[2] for x in docs_)
        epochs = int(targets[s] // size)
        due = math.floor(targets[s] - epochs * size + 0.5)
        for _, i, n in sorted(docs_):
            part = max(0, min(n, due))
            due -= part
            assert got[i]["taken"] == epochs * n + part and got[i]["size"] == n and got[i]["source_size"] == size
            assert got[i]["target"] == pytest.approx(targets[s])


def test_awkward_rows(spark):
    got = M.mix(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
    again = M.mix(awkward(spark)).collect()
    mark = lambda rows: sorted((str(r["doc_id"]), str(r["text"])[:50], r["taken"]) for r in rows)
    assert mark(got) == mark(again)
    assert M.mix(empty(spark)).collect() == []


def test_mixed_documents_repeat_whole_documents(spark):
    docs = awkward(spark)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = defaultdict(int)
    assert mixed.where("size <> 'x' or taken <> 'x' or target <> 'x'").isEmpty()  # the input's own columns
    for r in mixed.collect():
        copies[r["doc_id"], r["text"]] += 1
    have = defaultdict(int)
    for r in ROWS:
        have[r[0], r[1]] += 1
    assert set(copies) <= set(have) and all(n <= 2 * have[k] for k, n in copies.items())


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 400))
def test_better_documents_come_first_more_often(seed):
    drawn = [(key(i, "", 2.0 if i % 2 else 0.5, seed), i % 2) for i in range(2000)]
    first = [good for _, good in sorted(drawn)[:400]]
    assert sum(first) > 270


def test_targets_are_the_caps_where_the_budget_exceeds_them(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 0), (None, 7)], "source string, source_size long")
    for share in (2.0, 2.5):
        got = {r["source"]: r["target"] for r in M.source_targets(sizes, (3.0, 1.0, 2.0), share, 2.0).collect()}
        assert got == {"a": 20.0, "b": 0.0, None: 14.0}
