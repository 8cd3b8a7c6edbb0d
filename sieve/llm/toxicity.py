"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Input of a step is a word: its embedding (one component of which is its log odds of standing in a toxic document), and the mean of the
embeddings of its character trigrams, which is all an unknown word has. Two gated recurrent units read a window of words forwards and
backwards, attention weighs their states, and the weighted sum gives the window's logit. A text's score is the highest of its
windows, one every ``STRIDE`` words: no word of a long text is left out, but a passage of more than ``WINDOW - STRIDE + 1`` words may be seen in two parts.

Learned from a bounded sample of labelled rows (``ROWS`` of each label): word odds are counted by Spark, each sampled document gives
its most toxic window as the odds have it (documents that are not toxic give others as well), and the network is fitted to those windows, then
to the highest windows as the network itself sees them. Documents kept from the fit set the bias. Both weigh a sampled row by the inverse
of its label's sampling share, so a score of 0.5 answers the share of toxic documents in the corpus, not that in the sample.
Weights and word table are a small broadcast. Per unique word the input projections are computed once and looked up.

Cases: null and empty texts, and texts without a word, are a window without words, which is fitted as not toxic; without labelled rows of both kinds the
score is the share of toxic rows (0 without any); repeated rows score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import forget_kept, lean, release_memory, stage
from sieve.llm.langid import bounded_sample, held_out

ROWS = 3000
VOCABULARY = 20_000
WINDOW, STRIDE = 24, 8
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 6, 4096
ROUNDS = 3
#: One sampled document in FOLDS is kept from the fit and sets where a score of 0.5 lies, by at most SHIFT and half the log odds of the labels.
FOLDS, SHIFT = 5, 3.0
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.015, 0.02
#: A small sample is gone through more often than EPOCHS times, up to this many steps.
STEPS = 500
#: Words remembered, windows and texts run at once.
CACHE, TILE, TEXTS = 200_000, 2048, 256
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of all words, their ends marked, one word after the other; and each word's number of them."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.repeat(2 * np.arange(len(words)), counts) + np.arange(counts.sum())  # a word and its marks: two places more
    return ((codes[first] * 31 + codes[first + 1]) * 31 + codes[first + 2]) % CHAR_BUCKETS, counts


def window_starts(n: int) -> range:
    """Starts of overlapping windows that cover ``n`` words; one window for no words."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def word_odds(sample: DataFrame) -> pd.DataFrame:
    """word, odds: smoothed log ratio of the shares of toxic and other documents that hold it, less two standard errors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(words_of(text)):
                    seen.setdefault(w, [0, 0])[toxic] += 1
            both = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([b[0] for b in both], pa.int64()),
                                              pa.array([b[1] for b in both], pa.int64())], names=["word", "n0", "n1"])

    totals = sample.agg(F.sum(1 - F.col("toxic")).alias("t0"), F.sum("toxic").alias("t1")).first()
    counts = sample.select("text", "toxic").mapInArrow(lean(count), "word string, n0 long, n1 long")
    counts = counts.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    n0, n1 = F.col("n0") + 0.5, F.col("n1") + 0.5
    odds = F.log(n1 / (totals["t1"] + 1)) - F.log(n0 / (totals["t0"] + 1))
    sure = F.greatest(F.abs(odds) - 2 * F.sqrt(1 / n0 + 1 / n1), F.lit(0.0)) * F.signum(odds)
    odds = counts.select("word", sure.alias("odds"), (F.col("n0") + F.col("n1")).alias("n"))
    return odds.orderBy(F.desc(F.abs("odds")), F.desc("n"), "word").limit(VOCABULARY).toPandas()


def training_windows(sample: DataFrame, judge: dict[str, float] | Network) -> pd.DataFrame:
    """words (a window's, space-joined), toxic, weight: of each sampled document the window ``judge`` (word odds, or a network) holds
    to be the most toxic; of documents that are not toxic its first and middle windows too."""
    shared = sample.sparkSession.sparkContext.broadcast(judge)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        scorer = Scorer(judge) if isinstance(judge, Network) else None
        for batch in batches:
            out: list[tuple[str, int, float]] = []
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                starts = window_starts(len(words))
                if scorer:
                    logits = scorer.text_windows(words)
                else:
                    strength = np.cumsum([0.0, *(judge.get(w, 0.0) for w in words)])
                    logits = [strength[min(s + WINDOW, len(words))] - strength[s] for s in starts]
                chosen = {starts[int(np.argmax(logits))]}
                if not toxic:
                    chosen |= {starts[0], starts[len(starts) // 2]}
                out += [(" ".join(words[s:s + WINDOW]), toxic, weight) for s in sorted(chosen)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.float64())], names=["words", "toxic", "weight"])

    found = sample.select("text", "toxic", "weight").mapInArrow(lean(cut), "words string, toxic int, weight double")
    return found.distinct().toPandas().sort_values(["words", "toxic"])


def best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The value that tells the labels of most weight apart; of several the middle one, and none without both labels."""
    if len(np.unique(labels)) < 2:
        return 0.0
    order = np.argsort(logits)
    x, y, w = logits[order], labels[order], np.ones(len(order)) if weights is None else weights[order]
    right = np.r_[0, np.cumsum(w * (y == 0))] + np.r_[np.cumsum((w * (y == 1))[::-1])[::-1], 0]
    cuts = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    best = cuts[right >= right.max() - 1e-9 * w.sum()]  # equal but for rounding
    most = SHIFT + abs(np.log(w[y == 1].sum() / w[y == 0].sum())) / 2  # fit() leaves half the log odds of the labels to the cut
    return float(np.clip(best[len(best) // 2], -most, most))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """The weights. Directions are stacked: axis 0 is forwards, backwards. Layouts keep the batch last."""

    def __init__(self, words: list[str], odds: np.ndarray, seed: int = 3):
        rng, h, d = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        self.index = {w: i + 1 for i, w in enumerate(words)}  # 0: unknown
        emb = 0.02 * rng.standard_normal((len(words) + 1, WORD_DIM))
        emb[0, :], emb[1:, 0] = 0, np.clip(odds / 3, -1.5, 1.5)
        self.w = {
            "emb": emb, "chars": 0.1 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)),
            "wx": rng.standard_normal((2, 3 * h, d)) / np.sqrt(d), "bx": np.zeros((2, 3 * h, 1)),
            "u": rng.standard_normal((2, 3 * h, h)) / np.sqrt(h), "wa": rng.standard_normal((h, 2 * h)) / np.sqrt(2 * h), "ba": np.zeros((h, 1)),
            "va": rng.standard_normal((1, h)) / np.sqrt(h), "wo": rng.standard_normal((1, 2 * h)) / np.sqrt(2 * h), "bo": np.full((1, 1), -1.0),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def projections(self, words: list[str]) -> np.ndarray:
        """(words, 2, 3 HIDDEN): what the gates get from each word."""
        emb = self.w["emb"][[self.index.get(x, 0) for x in words]]
        buckets, counts = trigrams(words)
        chars = np.add.reduceat(self.w["chars"][buckets], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)
        x = np.concatenate([emb, chars], axis=1)
        return np.einsum("dgi,ni->ndg", self.w["wx"], x) + self.w["bx"][None, :, :, 0]

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """``gates`` (steps, 2, 3 HIDDEN, batch): projections, the backward direction's already in its own order; ``real``
        (steps, 2, 1, batch): whether a step has a word. Returns logits (batch,) and, if asked, what backward() needs."""
        h, steps, b = HIDDEN, gates.shape[0], gates.shape[-1]
        state, states, cache = np.zeros((2, h, b), gates.dtype), np.empty((steps, 2, h, b), gates.dtype), []
        for t in range(steps):
            rec = self.w["u"] @ state
            zr = sigmoid(gates[t, :, :2 * h] + rec[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates[t, :, 2 * h:] + r * rec[:, 2 * h:])
            new = n + z * (state - n)
            states[t] = np.where(real[t], new, state)
            if keep:
                cache.append((state, z, r, n, rec[:, 2 * h:]))
            state = states[t]
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
        att = np.tanh(self.w["wa"] @ both + self.w["ba"])
        word = real[:, 0, 0]
        weight = np.where(word, (self.w["va"] @ att)[:, 0], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * word
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, None] * both).sum(axis=0)
        logits = (self.w["wo"] @ pooled + self.w["bo"])[0]
        return (logits, (cache, both, att, weight, pooled)) if keep else logits

    def backward(self, real: np.ndarray, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights behind the projections, and of ``gates``."""
        cache, both, att, weight, pooled = kept
        h, w, steps = HIDDEN, self.w, len(cache)
        g = {"wo": d_logit[None] @ pooled.T, "bo": d_logit.sum().reshape(1, 1)}
        d_pooled = w["wo"].T @ d_logit[None]
        d_weight = (d_pooled[None] * both).sum(axis=1)
        d_both = weight[:, None] * d_pooled[None]
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tb,thb->h", d_score, att)[None]
        d_att = w["va"].T[None] * d_score[:, None] * (1 - att * att)
        g["wa"], g["ba"] = np.einsum("thb,tkb->hk", d_att, both), d_att.sum(axis=(0, 2))[:, None]
        d_both = d_both + w["wa"].T @ d_att
        d_states = np.stack([d_both[:, :h], d_both[::-1, h:]], axis=1)
        g["u"] = np.zeros_like(w["u"])
        d_gates, d_next = np.zeros((steps, 2, 3 * h, real.shape[-1]), both.dtype), np.zeros_like(d_states[0])
        for t in range(steps - 1, -1, -1):
            before, z, r, n, rec_n = cache[t]
            d = d_states[t] + d_next
            live = d * real[t]
            d_n = live * (1 - z) * (1 - n * n)
            d_z = live * (before - n) * z * (1 - z)
            d_r = d_n * rec_n * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_rec = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g["u"] += d_rec @ before.transpose(0, 2, 1)
            d_next = d - live + live * z + w["u"].transpose(0, 2, 1) @ d_rec
        return g, d_gates

    def fit(self, windows: list[list[str]], labels: np.ndarray, weights: np.ndarray | None = None, seed: int = 3) -> Network:
        """Adam on the logistic loss. ``weights``: the rows each window stands for; the label that is rarer by them weighs more than
        that, by the square root of its rarity."""
        rng, w = np.random.default_rng(seed), self.w
        vocab = sorted({x for win in windows for x in win})
        place = {x: i for i, x in enumerate(vocab)}
        flat, counts = trigrams(vocab)
        rows = np.array([self.index.get(x, 0) for x in vocab], np.int64)
        owner, inverse = np.repeat(np.arange(len(vocab)), counts), (1 / np.maximum(1, counts)).astype(np.float32)
        ids, real = window_matrix([[place[x] for x in win] for win in windows])
        weights = np.ones(len(labels)) if weights is None else weights
        toxic = (weights * (labels == 1)).sum() / weights.sum()
        balance = weights / weights.mean() * np.sqrt(0.5 / np.maximum(1e-12, np.where(labels == 1, toxic, 1 - toxic)))
        first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        epochs = max(EPOCHS, STEPS * BATCH // len(windows))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
                used, local = np.unique(ids[part], return_inverse=True)
                local = local.reshape(len(part), WINDOW)
                mine = np.flatnonzero(np.isin(owner, used))
                at = np.searchsorted(used, owner[mine])
                chars = np.zeros((len(used), CHAR_DIM), np.float32)
                np.add.at(chars, at, w["chars"][flat[mine]])
                x = np.concatenate([w["emb"][rows[used]], chars * inverse[used][:, None]], axis=1)
                proj = np.einsum("dgi,ni->ndg", w["wx"], x) + w["bx"][None, :, :, 0]
                gates, mask = arranged(proj, local, real[part])
                logits, kept = self.forward(gates, mask, keep=True)
                d_logit = ((sigmoid(logits) - labels[part]) * balance[part] / len(part)).astype(np.float32)
                g, d_gates = self.backward(mask, kept, d_logit)
                d_proj = np.zeros_like(proj)
                d_words = np.stack([d_gates[:, 0], d_gates[::-1, 1]], axis=1).transpose(3, 0, 1, 2)
                np.add.at(d_proj, local.ravel(), d_words.reshape(-1, 2, 3 * HIDDEN))
                g["wx"], g["bx"] = np.einsum("ndg,ni->dgi", d_proj, x), d_proj.sum(axis=0)[:, :, None]
                d_x = np.einsum("ndg,dgi->ni", d_proj, w["wx"])
                g["emb"], g["chars"] = np.zeros_like(w["emb"]), np.zeros_like(w["chars"])
                np.add.at(g["emb"], rows[used], d_x[:, :WORD_DIM])
                g["emb"][0] = 0  # an unknown word is known by its characters alone
                np.add.at(g["chars"], flat[mine], (d_x[:, WORD_DIM:] * inverse[used][:, None])[at])
                step += 1
                for k in w:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.001 * (g[k] * g[k] - second[k])
                    if k in ("emb", "chars"):  # all that tells words apart but their odds
                        w[k][:, k == "emb":] *= 1 - rate * DECAY
                    w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def window_matrix(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) numbers, 0 where there is no word, and where there is one."""
    ids, real = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), bool)
    for i, win in enumerate(windows):
        ids[i, :len(win)], real[i, :len(win)] = win, True
    return ids, real


def arranged(proj: np.ndarray, ids: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gates and mask as forward() takes them: steps first, batch last, the backward direction reversed."""
    gates = np.stack([proj[ids.T, 0], proj[ids.T[::-1], 1]], axis=1).transpose(0, 1, 3, 2)
    mask = np.stack([real.T, real.T[::-1]], axis=1)[:, :, None]
    return np.ascontiguousarray(gates), mask


class Scorer:
    """Scores batches of texts; remembers the projections of up to ``CACHE`` words."""

    def __init__(self, network: Network):
        self.network, self.place = network, {}
        self.proj = np.zeros((1 << 12, 2, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        place = self.place
        new = [w for w in set(words) if w not in place]
        if len(place) + len(new) > CACHE:
            place.clear()
            new = list(set(words))
        if new:
            need = len(place) + len(new)
            if need > len(self.proj):
                self.proj = np.concatenate([self.proj, np.zeros((max(need - len(self.proj), len(self.proj)), 2, 3 * HIDDEN), np.float32)])
            self.proj[len(place):need] = self.network.projections(new)
            place.update(zip(new, range(len(place), need), strict=True))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def windows(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logit of each window: words ``starts`` to ``ends`` of ``ids``."""
        out = np.empty(len(starts), np.float32)
        for lo in range(0, len(starts), TILE):
            a, b = starts[lo:lo + TILE], ends[lo:lo + TILE]
            at = a[:, None] + np.arange(WINDOW)
            real = at < b[:, None]
            own = ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else np.zeros(at.shape, np.int64)
            out[lo:lo + TILE] = self.network.forward(*arranged(self.proj, own, real))
        return out

    def text_windows(self, words: list[str]) -> np.ndarray:
        starts = np.array(window_starts(len(words)))
        return self.windows(self._numbers(words), starts, np.minimum(starts + WINDOW, len(words)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        base = np.cumsum([0, *map(len, words)])
        ids = self._numbers([w for ws in words for w in ws])
        starts = [base[i] + s for i, ws in enumerate(words) for s in window_starts(len(ws))]
        counts = np.array([len(window_starts(len(ws))) for ws in words])
        ends = np.minimum(np.array(starts) + WINDOW, np.repeat(base[1:], counts))
        logits = self.windows(ids, np.array(starts), ends)
        return sigmoid(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64))


def train(labelled: DataFrame) -> Network | float:
    """Learn from a bounded sample of (text, toxic, weight) rows; a constant score where the labels do not hold both kinds."""
    every = labelled.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), "weight").persist()
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS))
    sample = every.where(fold > 0)
    try:
        kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if len(kinds) < 2:
            return float(1 in kinds)
        odds = word_odds(sample)
        windows = training_windows(sample, dict(zip(odds["word"], odds["odds"], strict=True)))
        network = Network(odds["word"].tolist(), odds["odds"].to_numpy())
        for _ in range(ROUNDS):
            texts = [t.split() for t in windows["words"]] + [[]] * 16
            toxic, weight = windows["toxic"].to_numpy(np.float32), windows["weight"].to_numpy()
            network.fit(texts, np.r_[toxic, np.zeros(16, np.float32)], np.r_[weight, np.full(16, weight[toxic == 0].max())])
            # The next round adds each document's highest window as this network sees it: what a text's score will be.
            mined = training_windows(sample, network)
            clean = pd.concat([windows, mined])
            windows = pd.concat([mined[mined["toxic"] == 1], clean[clean["toxic"] == 0]]).drop_duplicates().sort_values(["words", "toxic"])
        apart = score(every.where(fold == 0), network).select("score", "toxic", "weight").toPandas()
        odds_of = np.clip(apart["score"].to_numpy(), 1e-9, 1 - 1e-9)
        network.w["bo"] -= np.float32(best_cut(np.log(odds_of / (1 - odds_of)), apart["toxic"].to_numpy(), apart["weight"].to_numpy()))
    finally:
        every.unpersist()
    return network


def score(docs: DataFrame, network: Network | float, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_kept()
        net = shared.value
        scorer = None if isinstance(net, float) else Scorer(net)
        try:
            for texts in batches:
                if scorer is None:
                    yield pd.Series(np.full(len(texts), net))
                else:
                    parts = [scorer.score(texts.iloc[at:at + TEXTS].tolist()) for at in range(0, len(texts), TEXTS)]
                    yield pd.Series(np.concatenate([np.zeros(0), *parts]))
        finally:
            del scorer
            release_memory()

    return docs.withColumn(out, run(F.col(text_col).cast("string")))


def drop_toxic(docs: DataFrame, network: Network | float, least: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``least`` or more."""
    return score(docs, network, out="__tx").where(F.col("__tx") < least).select(*docs.columns)


def labelled_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, toxic, weight) of a sample of the labelled documents that may be learned from: about ``rows`` of each label, each
    weighing as many as it stands for. A label that is repeated counts once. About ``rows`` ids of each label are drawn first, a bounded
    broadcast, so documents are not shuffled; then of their documents, which are more where an id is repeated, about ``rows`` of each label."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stage(bounded_sample(marks, "toxic", "doc_id", rows, weight="ids"), "toxicity-ids")  # read twice: to count and to draw
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    drawn = bounded_sample(found, "toxic", "doc_id", rows, seed=6, weight="rows")
    return drawn.select("text", "toxic", (F.col("ids") * F.col("rows")).alias("weight"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op9."""
    network = train(labelled_documents(docs, labels))
    rows = docs.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "text")
    return score(rows, network).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
