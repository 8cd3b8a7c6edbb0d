"""The stages of the corpus pipeline, each on its predecessor's output, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from conftest import SF_SMALL
from sieve.llm import mixing, simhash
from sieve.llm.common import stage


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, step in C.STAGES:
        out.append(stage(step(spark, out[-1], SF_SMALL), name))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "mixing", "packing"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:5])


def test_filters_keep_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = set(ids(steps[1]))
    clean = [d for d in ids(steps[0]) if labels.get(d) == 0]
    assert np.mean([d in kept for d in clean]) > 0.9
    assert set(ids(steps[2])) == {r["doc_id"] for r in steps[1].collect() if any(c.isalpha() for c in r["text"] or "")}


def test_languages_are_those_op1_predicts(spark):
    """Held-out documents whose lang is taken away get the language of the operator's prediction; given ones keep theirs."""
    from pyspark.sql import functions as F

    from sieve.llm import langid

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = docs.withColumn("lang", F.when(~langid.held_out(4, 2), F.col("lang")))
    want = {r["doc_id"]: r["lang_pred"] for r in langid.predicted_languages(docs).where("held_out").collect()}
    given = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r["lang"] for r in C.keep_identified(spark, docs, SF_SMALL).collect()}
    assert len(want) > 20 and all(lang == (want[d] if d in want else given[d] or lang) for d, lang in got.items())
    assert None not in got.values() and {d for d, lang in want.items() if lang != "und"} <= set(got)


def test_one_document_of_each_group_stays(steps):
    marks = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in steps[2].collect()}
    group = {d: d for d in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            low = min(group[b] for b in marks if (marks[a] ^ marks[b]).bit_count() <= 4)
            if low < group[a]:
                group[a], changed = low, True
    assert sorted(ids(steps[3])) == sorted({group[d] for d in marks})


def test_sources_meet_their_targets(steps):
    rows = mixing.mix(steps[3], cut="documents").collect()
    taken = Counter(ids(steps[4]))
    assert all(n <= 2 for n in taken.values()) and set(taken) <= set(ids(steps[3]))
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        words = sum(taken[r["doc_id"]] * r["size"] for r in mine)
        assert abs(words - mine[0]["target"]) <= max(r["size"] for r in mine)


def test_every_token_is_packed_once(steps):
    from sieve.llm.tokens import Encoder, default_tokenizer

    library = Encoder(default_tokenizer()).tokenizer
    want = Counter()
    for r in steps[4].collect():
        want[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, pieces = Counter(), steps[5].collect()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want
    sizes = Counter()
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    assert sum(n < 1024 for n in sizes.values()) <= 1 and max(sizes.values()) == 1024
    text = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in steps[4].collect()}
    assert all(zlib.crc32(text[p["doc_id"]][p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)


def test_run(spark, steps):
    got = C.run(spark, SF_SMALL)
    assert got.columns == steps[5].columns and got.count() == steps[5].count()


def written(spark, docs, labels):
    from sieve.llm.common import scratch_path

    path = scratch_path(spark, "pipeline-input")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_run_over_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with clashing names."""
    from llm_data import awkward

    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (6, 0, None), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    path = written(spark, docs, labels)
    current, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, step in C.STAGES[:-1]:
        current = stage(step(spark, current, path), name)
        assert current.columns == docs.columns, name
        seen.append({str(r["doc_id"]): r["text"] for r in current.collect()})
    assert all(any(c.isalpha() for c in t) for t in seen[1].values())  # null, empty and blank texts have no language
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:], strict=False))
    pieces = C.run(spark, path).collect()
    assert {str(p["doc_id"]) for p in pieces} == set(seen[3])


def test_run_over_empty_tables(spark):
    from llm_data import empty

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = written(spark, empty(spark), labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, step in C.STAGES[:-1]:
        assert step(spark, docs, path).collect() == [], name
    assert C.run(spark, path).collect() == []


def test_a_run_keeps_only_its_stages(spark):
    from sieve import staging

    with staging.staged_job(spark) as paths:
        C.run(spark, SF_SMALL).count()
        kept = [p.rsplit("/", 1)[1] for p in paths]
        assert [k.rsplit("-", 1)[0] for k in kept if k.startswith("pipeline-")] == [f"pipeline-{n}" for n, _ in C.STAGES[:-1]]
        assert not any(k.startswith(("ball-links", "fingerprints", "mix-", "toxicity")) for k in kept)
