"""The plan places every tail once and fills every sequence but the last; packed pieces against brute force."""

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import ROWS, awkward, empty
from sieve.llm import packing as P
from sieve.llm.tokens import Encoder, default_tokenizer


def laid_out(histogram, capacity):
    """Sequence -> pieces, and tail (length, number) -> pieces, from the plan's lines."""
    lines, n = P.plan(histogram, capacity)
    by_sequence, by_tail = defaultdict(list), defaultdict(list)
    for length, first, count, start, taken, place, copies, sequence, offset in lines.tolist():
        for k in range(count):
            at = place + k
            by_sequence[sequence + at // copies].append((offset + at % copies * taken, taken))
            by_tail[length, first + k].append((start, taken))
    return by_sequence, by_tail, n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=12))
def test_plan(histogram):
    by_sequence, by_tail, n = laid_out(histogram, 32)
    assert set(by_tail) == {(length, i) for length, c in histogram.items() for i in range(c)}
    for (length, _), parts in by_tail.items():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) == length
    assert sorted(by_sequence) == list(range(n))
    sizes = []
    for parts in by_sequence.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist()
        sizes.append(sum(p[1] for p in parts))
    assert all(s <= 32 for s in sizes) and sum(s < 32 for s in sizes) <= 1


def test_best_fill_is_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        stock = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 4)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, c in stock.items():
            sums = {s + k * j for s in sums for j in range(c + 1)}
        used = P.best_fill(room, stock)
        assert sum(k * c for k, c in used.items()) == max(s for s in sums if s <= room)
        assert all(c <= stock[k] for k, c in used.items())


def test_a_hot_length_is_filled_by_cutting():
    by_sequence, _, n = laid_out({700: 100_000}, 1024)
    assert n == -(-700 * 100_000 // 1024)


def test_plan_stays_small():
    rng = np.random.default_rng(2)
    lines, _ = P.plan({i: int(rng.integers(1, 10**9)) for i in range(1, 1025)})
    assert len(lines) < 20_000


def test_pack(spark):
    library = Encoder(default_tokenizer()).tokenizer
    got = P.pack(awkward(spark), keep_ids=True).collect()
    whole = defaultdict(int)  # (doc_id, ids) -> how many rows
    for r in ROWS:
        whole[r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    covered = defaultdict(int)
    for p in got:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] <= 4096
        fits = [k for k in whole if k[0] == p["doc_id"] and len(k[1]) == 4 * p["doc_tokens"]
                and k[1][4 * p["start"]:4 * (p["start"] + p["length"])] == p["ids"]]
        assert len(fits) == 1
        covered[fits[0]] += p["length"]
    assert covered == {k: n * len(k[1]) // 4 for k, n in whole.items()}
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    sizes = []
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        sizes.append(sum(n for _, n in parts))
    assert sum(s < 1024 for s in sizes) <= 1
    made = P.sequences(P.pack(awkward(spark), keep_ids=True)).collect()
    assert len(made) == len(by_sequence)
    for s in made:
        power = s["length"] & (s["length"] - 1) == 0
        assert len(s["ids"]) == (4 * s["length"] if power else 4096)
    assert P.pack(empty(spark)).collect() == []
