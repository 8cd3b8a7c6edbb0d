"""The network: gradients against differences, windows, awkward texts, held-out accuracy."""

import numpy as np
import pytest
from llm_data import ROWS, awkward, empty
from pyspark.sql import functions as F

from sieve.llm import toxicity as T

SF_LARGER = "/root/testdata/sf0.1"  # the small tables hold too few toxic documents to learn from


def test_best_cut():
    assert T.best_cut(np.array([-3.0, -1.0, 0.5, 2.0]), np.array([0, 0, 1, 1])) == -0.25
    assert T.best_cut(np.array([1.0, 2.0]), np.array([0, 0])) == 0.0
    assert T.best_cut(np.array([-9.0, 9.0]), np.array([1, 0])) in (-T.SHIFT, T.SHIFT, 0.0)


def test_the_cut_and_the_loss_answer_the_weights():
    logits, labels = np.array([-2.0, -1.0, -0.5, 1.0, 2.0, 3.0]), np.array([0, 1, 1, 0, 1, 1])
    assert T.best_cut(logits, labels) == -1.5  # one error against two
    assert T.best_cut(logits, labels, np.where(labels == 0, 50.0, 1.0)) == 1.5  # a clean row that stands for 50 is not given up
    windows = [["same", f"word{i % 7}"] for i in range(400)]
    labels = np.tile([0.0, 1.0], 200).astype(np.float32)
    for weight, low, high in ((1.0, 0.4, 0.6), (100.0, 0.0, 0.25)):
        net = T.Network(["same"], np.zeros(1)).fit(windows, labels, np.where(labels == 0, weight, 1.0))
        found = T.Scorer(net).score(["same word1", "same word4"])
        assert (low <= found).all() and (found <= high).all()


@pytest.mark.parametrize("rows", [40, 10_000])
def test_sampled_labels_stand_for_the_corpus(spark, rows):
    """60 toxic documents of 6,000: the weights of a sample add up to both counts at every size of it."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 100 == 7).cast("int").alias("toxic"))
    learned = labels.where(~T.held_out(5, 0)).groupBy("toxic").count().collect()
    got = {r["toxic"]: r for r in T.labelled_documents(docs, labels, rows).groupBy("toxic").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    for r in learned:
        assert got[r["toxic"]]["w"] == pytest.approx(r["count"], rel=0.0 if rows > 6000 else 0.6)
        assert rows > 6000 or got[r["toxic"]]["n"] < 80
    assert got[1]["w"] / got[0]["w"] < 0.05


def test_rows_that_repeat_an_id_do_not_swell_the_sample(spark):
    """Every id is sampled; one of them holds 5,000 of 5,400 rows."""
    ids = spark.range(400).select(F.col("id").alias("doc_id"))
    hot = ids.where(~T.held_out(5, 0)).first()["doc_id"]
    docs = ids.unionByName(spark.range(5000).select(F.lit(hot).alias("doc_id"))).withColumn("text", F.lit("some text"))
    labels = ids.select("doc_id", (F.col("doc_id") % 2 == hot % 2).cast("int").alias("toxic"))
    got = {r["toxic"]: r for r in T.labelled_documents(docs, labels, 300).groupBy("toxic").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert got[1]["n"] < 400 and got[1]["w"] == pytest.approx(5160, rel=0.3)
    assert got[0]["w"] == got[0]["n"] < 300


def test_windows_cover_every_word_and_overlap():
    for n in range(0, 200):
        starts = list(T.window_starts(n))
        assert {i for s in starts for i in range(s, min(s + T.WINDOW, n))} == set(range(n))
        assert all(b - a == T.STRIDE < T.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_gradients():
    net = T.Network(["aa", "bb"], np.array([2.0, -1.0]))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    gates = rng.standard_normal((5, 2, 3 * T.HIDDEN, 3))  # float64 all through
    real = np.ones((5, 2, 1, 3), bool)
    real[3:, 0, :, 1] = False
    real[:2, 1, :, 1] = False

    def loss():
        return float(net.forward(gates, real).sum())

    _, kept = net.forward(gates, real, keep=True)
    grads, d_gates = net.backward(real, kept, np.ones(3))
    for name in ("u", "wa", "ba", "va", "wo", "bo"):
        at = tuple(int(rng.integers(0, n)) for n in net.w[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-5
        up = loss()
        net.w[name][at] = old - 1e-5
        assert grads[name][at] == pytest.approx((up - loss()) / 2e-5, rel=1e-2, abs=1e-4), name
        net.w[name][at] = old
    at = (1, 0, 5, 0)
    gates[at] += 1e-5
    up = loss()
    gates[at] -= 2e-5
    assert d_gates[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-2, abs=1e-4)


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(60)]
    windows = [[*rng.choice(plain, 10).tolist()] for _ in range(400)]
    labels = np.zeros(400, np.float32)
    for i in range(0, 400, 2):
        windows[i][int(rng.integers(0, 10))] = ["nasty", "vile"][i % 4 // 2]
        labels[i] = 1
    return T.Network(["nasty", "vile", *plain], np.array([4.0, 4.0] + [0.0] * 60)).fit(windows + [[]] * 8, np.concatenate([labels, np.zeros(8, np.float32)]))


def test_a_word_anywhere_in_a_long_text_counts(network):
    plain = [f"word{i % 60}" for i in range(3000)]
    for place in (0, 1, 1500, 2999):
        bad = [*plain[:place], "Nasty", *plain[place + 1:]]
        found = T.Scorer(network).score([" ".join(plain), " ".join(bad), "", None, "   ", "!!"])
        assert found[1] > 0.5 > found[0] and (found[2:] < 0.5).all()


def test_batches_and_cache_do_not_change_scores(network, monkeypatch):
    texts = ["word1 vile word2", "", "word3 " * 100, "new words here"]
    alone = [float(T.Scorer(network).score([t])[0]) for t in texts]
    assert T.Scorer(network).score(texts) == pytest.approx(alone, abs=1e-6)
    monkeypatch.setattr(T, "CACHE", 3)
    tight = T.Scorer(network)
    assert [float(tight.score([t])[0]) for t in texts] == pytest.approx(alone, abs=1e-6)


def test_awkward_rows(spark, network):
    docs = awkward(spark)
    got = T.score(docs.drop("score"), network).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    kept = T.drop_toxic(docs, network)
    assert kept.columns == docs.columns
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 0), (None, 1, 1), (7, 1, None), (99, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = T.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = T.toxicity_scores(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert T.toxicity_scores(empty(spark), labels).collect() == []
    assert {r["score"] for r in T.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col("toxic")).toPandas()
    assert len(got) > 500 and (got["predicted"] == got["toxic"]).mean() > 0.96
    assert got.loc[got["toxic"] == 1, "predicted"].mean() > 0.75 and got.loc[got["toxic"] == 0, "predicted"].mean() < 0.02
