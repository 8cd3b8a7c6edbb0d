"""Encoding by pieces equals the library's; Simple-8b round trips; token files against brute force."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import ROWS, awkward, empty
from sieve.llm import tokenfile as TF
from sieve.llm.tokens import Encoder, default_tokenizer, slices, with_end


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def library(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


TEXT = st.text(st.sampled_from(list("abé'ß1 \n\t.,| 　\x1f漢😀")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_ids_equal_the_library(texts):
    encoder = Encoder.of(default_tokenizer())
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    want = library(encoder, texts)
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_cache_eviction_keeps_ids_right(encoder, monkeypatch):
    monkeypatch.setattr("sieve.llm.tokens.CACHE_PIECES", 200)
    rng = np.random.default_rng(0)
    for _ in range(30):
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 30)) for _ in range(2)]
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for w in library(encoder, texts) for i in w]


def test_slices_cover_all_rows():
    col = pa.array(["x" * n for n in (5, 0, 900, 1, 1, 2000, 3)] + [None])
    runs = slices(col, 1000)
    assert [i for a, n in runs for i in range(a, a + n)] == list(range(8))
    assert slices(pa.array([], pa.string())) == []


def test_end_ids():
    ids, sizes = with_end(np.array([5, 6, 7], np.uint32), np.array([2, 0, 1]))
    assert ids.tolist() == [5, 6, 0, 0, 7, 0] and sizes.tolist() == [3, 1, 2]


IDS = st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**60), st.integers(0, 2**64 - 1)), max_size=60)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(IDS, st.integers(1, 90)), max_size=6))
def test_simple8b_round_trip(runs):
    ids = np.array([i for part, times in runs for i in part * times], np.uint64)
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = TF.TokenWriter(sink)
    cut = len(ids) // 3
    writer.add(pa.array([1, None]), ids[:cut], np.array([cut, 0]))
    writer.add(pa.array([2]), ids[cut:], np.array([len(ids) - cut]))
    assert writer.close() == (3, len(ids))
    docs, nulls, sizes, table = TF.read_index(sink.getvalue())
    assert nulls.tolist() == [False, True, False] and sizes.tolist() == [cut, 0, len(ids) - cut]
    assert (TF.read_ids(sink.getvalue(), table, 0, len(ids)) == ids).all()
    lo, hi = len(ids) // 4, len(ids) - len(ids) // 5
    assert (TF.read_ids(sink.getvalue(), table, lo, hi) == ids[lo:hi]).all()


def test_words_pack_many_small_ids():
    words, per_block, _ = TF.encode_blocks(np.zeros(TF.BLOCK, np.uint64))
    assert len(words) < 12 and per_block.tolist() == [len(words)]
    assert len(TF.encode_blocks(np.full(TF.BLOCK, 30_000))[0]) == TF.BLOCK // 4


def test_token_files(spark, encoder):
    got = TF.token_files(awkward(spark)).collect()
    want = sorted(((r[0], library(encoder, [r[1] or ""])[0] + [0]) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (d or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [d for d, _ in want]  # nulls first, then ascending
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1].tolist()
    assert TF.token_files(empty(spark)).collect() == []


def test_files_are_cut_and_read_back(spark):
    from sieve.llm.common import scratch_path

    docs = spark.createDataFrame([(i, f"some words {i} " * 50) for i in range(300)], "doc_id long, text string")
    manifest = TF.write_token_files(docs, scratch_path(spark, "tokens"), file_tokens=4000)
    assert manifest.count() > 5
    back = TF.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == list(range(300))
