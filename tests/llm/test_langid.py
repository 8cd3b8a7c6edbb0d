"""Language identification: back-off, awkward texts, held-out accuracy."""

import numpy as np
import pandas as pd
import pytest
from llm_data import ROWS, awkward, empty
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from sieve.llm import langid as L


def model():
    rows = []
    for lang, words in {"aa": ["hello", "helium", "help"], "bb": ["zebra", "zero", "help"]}.items():
        for w in words:
            rows.append((lang, 0, w, 5))
            rows += [(lang, n, g, 5) for n in range(1, 6) for g in L.grams_of(w, n)]
    counts = pd.DataFrame(rows, columns=["lang", "n", "gram", "times"]).groupby(["lang", "n", "gram"], as_index=False).sum()
    counts["total"] = counts.groupby(["lang", "n"])["times"].transform("sum")
    return L.Model(counts)


def test_known_words_come_first_then_the_longest_grams():
    m = model()
    assert m.languages == ["aa", "bb"]
    assert (m.word("hello") == m.table[0][m.known[0]["hello"]]).all()
    unseen = m.word("helios")  # "<heli" is the longest gram known
    rows = [m.known[5][g] for g in L.grams_of("helios", 5) if g in m.known[5]]
    assert rows and unseen == pytest.approx(m.table[5][rows].mean(axis=0))
    short = m.word("ez")  # only pairs and letters are known
    assert short[1] > short[0] and not m.word("ыы").any()


def test_predictions():
    p = L.Predictor(model())
    assert p.predict("Hello HELIUM unseen") [0] == "aa" and p.predict("zebras zeros")[0] == "bb"
    for text in (None, "", "  ", "123 !?", "\n²Ⅷ"):
        assert p.predict(text) == ("und", 0.0)
    lang, score = p.predict("ыы")
    assert lang == "aa" and score == pytest.approx(0.5)  # letters that tell nothing: level, first label
    long = p.predict("hello zebra " * 50_000 + "hello")
    assert 0 < long[1] <= 1


def test_cache_limit_does_not_change_scores(monkeypatch):
    free = L.Predictor(model())
    monkeypatch.setattr(L, "CACHE", 3)
    tight = L.Predictor(model())
    rng = np.random.default_rng(0)
    for _ in range(20):
        text = " ".join(rng.choice(["hello", "zebra", "zest", "helm", "zoo", "held"], 8))
        assert tight.predict(text) == free.predict(text)


def test_awkward_rows(spark):
    got = L.predicted_languages(awkward(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)
    assert L.predicted_languages(empty(spark)).collect() == []
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in L.predicted_languages(unlabelled).collect()} == {("und", 0.0)}
    docs = awkward(spark)
    kept = L.drop_unidentified(docs, model())
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").isEmpty()
    unknown = spark.createDataFrame([(1, "漢字かな"), (2, "hello"), (3, "hello zebra zoo")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in L.drop_unidentified(unknown, model()).collect()) == [2, 3]


def test_level_texts_stay_and_only_unknown_ones_go(spark):
    docs = spark.createDataFrame([(1, "help"), (2, "hello zebra"), (3, "ыы"), (4, "12 !"), (5, "ыы help"), (6, None)], "doc_id long, text string")
    known = model()  # two languages; "help" is as common in both
    assert L.Predictor(known).predict("help")[1] == pytest.approx(0.5, abs=0.1)
    assert sorted(r["doc_id"] for r in L.drop_unidentified(docs, known).collect()) == [1, 2, 5]
    nothing = L.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r["doc_id"] for r in L.drop_unidentified(docs, nothing).collect()) == [1, 2, 3, 5]


def test_words_that_tell():
    p = L.Predictor(model())
    for text, told in (("help ыы zebra", 2), ("ыы", 0), ("12 !", 0), (None, 0), ("zebra " * 300, 300)):
        assert p.judge(text) == (*p.predict(text), told)
    assert L.Predictor(L.Model(pd.DataFrame(columns=["lang", "n", "gram", "times", "total"]))).judge("ыы 12 help") == ("und", 0.0, 2)


def test_documents_are_dropped_by_the_prediction_of_their_whole_texts(spark):
    texts = [(1, "hello zebra zero zebra", None), (2, "zero hello helium", None), (3, "zebra", "aa"), (4, "ыы", None), (5, None, "aa")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    kept = L.drop_unidentified(docs, model(), lang_col="lang")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(kept.select("doc_id", "lang").collect()) == [(1, "bb"), (2, "aa"), (3, "aa")]  # the first word alone would say aa, bb
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # each text is predicted once
    nothing = L.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["doc_id"]: r["lang"] for r in L.drop_unidentified(docs, nothing, lang_col="lang").collect()} == {1: None, 2: None, 3: "aa", 4: None}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = L.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.97
