"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ROWS, awkward, empty

from sieve.llm import variants as V


def edits(a, b):
    """Levenshtein distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{word}".encode())
                if h % 31 == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def brute_near(counts):
    by = {}
    for w in counts:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1:]), set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            near[w] |= by[i, w[:i], w[i + 1:]] - {w}
            shorter = w[:i] + w[i + 1:]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def brute(counts, ratio=10):
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = rows(V.variant_groups(docs))
    assert got == brute(counts) and sum(r[1] is not None for r in got) > 20


def test_awkward_rows(spark):
    assert rows(V.variant_groups(awkward(spark))) == brute(brute_words([r[:2] for r in ROWS]))
    assert V.variant_groups(empty(spark)).collect() == []


@pytest.mark.parametrize("tile,groups", [(7, 2), (2048, 3), (20, 6)])
def test_tiles_and_groups_do_not_change_the_result(spark, tile, groups):
    rng = random.Random(tile)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 7))): rng.choice([1, 2, 30, 400]) for _ in range(300)}
    words |= {"ab": 5, "a": 50, "😀bc": 7, "bc": 700, "Ābc": 2}  # beyond Latin-1; one is short
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(V.spelling_variants(df, tile=tile, groups=groups)) == brute(words)


def test_chains_of_forms_and_ties(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "zzzzzzz": 3, "zzzzzzy": 30, "zzzzzzx": 30}
    got = {r[0]: r for r in rows(V.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["aaaaaaa"][1:3] == ("aaaaaab", "aaaabbb") and got["zzzzzzz"][1] == "zzzzzzx"
    assert got == {r[0]: r for r in brute(words)}


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=7), st.text("ab", min_size=1, max_size=7))
def test_one_edit_is_levenshtein_one(a, b):
    a, b = max(a, b, key=len), min(a, b, key=len)
    if len(a) - len(b) > 1:
        return
    i, j = V.near_pairs(V.Block.of([a]), V.Block.of([b]), False)
    assert bool(len(i)) == (edits(a, b) == 1)


def test_long_words_are_exact():
    a = "a" * 5000
    words = [a + "b", a + "c", "b" + a]
    i, j = V.near_pairs(V.Block.of(words), V.Block.of(words), True)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1)] and V.Block.of(words).counts.dtype == np.float64


def test_steps_between_blocks_cover_near_words():
    for groups in (2, 3, 5):
        steps = V.neighbours(groups)
        both = {tuple(s) for s in steps} | {tuple(-x for x in s) for s in steps}
        want = {tuple(s) for s in np.ndindex(*[3] * groups)}
        want = {tuple(x - 1 for x in s) for s in want}
        assert both == {s for s in want if sum(map(abs, s)) <= 2 and abs(sum(s)) <= 1}
