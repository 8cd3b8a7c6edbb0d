"""op1 and op9 against slow scorers that share nothing with them but the learned numbers; the llm oracles in DuckDB."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from llm_data import LONG, ROWS, awkward

from conftest import SF_SMALL
from sieve.llm import langid as L
from sieve.llm import toxicity as T
from sieve.llm.catalog import ORACLE, QUERIES


def slow_language(counts, text):
    """Word by word and gram by gram from the table of counts."""
    times, totals, grams = {}, {}, {}
    for r in counts.itertuples():
        times[r.n, r.gram, r.lang] = r.times
        totals[r.n, r.lang] = r.total
        grams.setdefault(r.n, set()).add(r.gram)
    languages = sorted({r.lang for r in counts.itertuples()})
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not languages or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    chance = lambda n, g, lang: math.log((times.get((n, g, lang), 0) + 0.5) / (totals.get((n, lang), 0) + 0.5 * max(1, len(grams.get(n, ())))))
    sums = dict.fromkeys(languages, 0.0)
    for w in words:
        found = [(0, w)] if w in grams.get(0, ()) else []
        for n in range(5, 0, -1):
            if not found:
                marked = f"<{w}>" if n > 1 else w
                found = [(n, marked[i:i + n]) for i in range(len(marked) - n + 1) if marked[i:i + n] in grams.get(n, ())]
        for lang in languages:
            sums[lang] += sum(chance(n, g, lang) for n, g in found) / len(found) if found else 0.0
    top = max(sums.values())
    odds = {lang: math.exp((s - top) * min(len(words), L.TRUSTED) / len(words)) for lang, s in sums.items()}
    best = min(languages, key=lambda x: (-sums[x], x))
    return best, odds[best] / sum(odds.values())


def test_op1_equals_the_slow_scorer(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {}
    plain = L.count_grams
    monkeypatch.setattr(L, "count_grams", lambda sample: kept.setdefault("counts", plain(sample)))
    got = {r["doc_id"]: r for r in L.predicted_languages(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow_language(kept["counts"], r["text"])
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert mine["score"] == pytest.approx(score, abs=2e-3) and (mine["lang_pred"] == lang or abs(score - 1 / 2) < 1e-3)


def slow_toxicity(net, text):
    """Every window on its own, step by step."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    h = T.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall(r"[^\W_]+", (text or "").lower())
    inputs = []
    for word in words:
        marked = f"<{word}>"
        buckets = [((ord(marked[i]) * 31 + ord(marked[i + 1])) * 31 + ord(marked[i + 2])) % T.CHAR_BUCKETS for i in range(len(marked) - 2)]
        inputs.append(np.r_[w["emb"][net.index.get(word, 0)], w["chars"][buckets].mean(axis=0)])
    best = -np.inf
    for start in range(0, max(1, len(words) - (T.WINDOW - T.STRIDE)), T.STRIDE):
        window = inputs[start:start + T.WINDOW]
        sides = []
        for d, order in ((0, window), (1, window[::-1])):
            state, states = np.zeros(h), []
            for x in order:
                gates, rec = w["wx"][d] @ x + w["bx"][d, :, 0], w["u"][d] @ state
                z, r = sigmoid(gates[:h] + rec[:h]), sigmoid(gates[h:2 * h] + rec[h:2 * h])
                n = np.tanh(gates[2 * h:] + r * rec[2 * h:])
                state = (1 - z) * n + z * state
                states.append(state)
            sides.append(states if d == 0 else states[::-1])
        both = [np.r_[a, b] for a, b in zip(*sides, strict=True)]
        pooled = np.zeros(2 * h)
        if both:
            marks = np.array([float(w["va"][0] @ np.tanh(w["wa"] @ b + w["ba"][:, 0])) for b in both])
            share = np.exp(marks - marks.max())
            pooled = (share / share.sum()) @ np.array(both)
        best = max(best, float(w["wo"][0] @ pooled + w["bo"][0, 0]))
    return float(sigmoid(best))


def test_op9_equals_the_slow_scorer(spark, monkeypatch):
    docs = awkward(spark, clash=False).where("text is null or length(text) < 10000").unionByName(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id % 9 = 0"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    vocabulary = sorted({x for _, t in rows for x in T.words_of(t)})[::3]
    net = T.Network(vocabulary, np.linspace(-3, 3, len(vocabulary)))
    monkeypatch.setattr(T, "train", lambda labelled: net)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = sorted(((r["doc_id"] or 0, r["held_out"], r["predicted"]), r["score"]) for r in T.toxicity_scores(docs, labels).collect())
    want = []
    for d, t in rows:
        score = slow_toxicity(net, t)
        want.append(((d or 0, d is not None and zlib.crc32(str(d).encode()) % 5 == 0, int(score >= 0.5)), score))
    want.sort()
    assert len({round(s, 6) for _, s in want}) > 10
    assert [g[1] for g in sorted(got, key=lambda x: (x[0][:2], x[1]))] == pytest.approx([s[1] for s in sorted(want, key=lambda x: (x[0][:2], x[1]))], abs=2e-5)
    assert [g[0][:2] for g in got] == [s[0][:2] for s in want] and len(LONG) > 0 and len(ROWS) > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF_SMALL), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    rows = lambda cols, data: sorted(tuple(norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in data)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
