"""Language identification by word-first backoff.

A word of the model scores by its log frequency in each language. A word the model does not know falls back to character n-grams of
the word with its ends marked: the longest n for which the model knows any of them, five down to one, scores by their mean log
frequency. A text's language is the one with the greatest sum over all its words.

Learned from a bounded sample of labelled rows (``ROWS_PER_LANGUAGE``); the model keeps ``WORDS`` words and ``GRAMS`` n-grams of each length
for a language, so it is a small broadcast whatever the corpus. Prediction reads each whole text and nothing else.

Cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled row every text is ``und``; words that tell
nothing (no n-gram known) leave the languages level, ties go to the first label by code point; repeated rows are predicted alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import forget_kept, lean, release_memory

ROWS_PER_LANGUAGE = 2000
#: More labels than this are an error.
LANGUAGES = 500
WORDS, GRAMS, LONGEST = 20_000, 8_000, 5
#: Words a text's confidence is based on at most: mean log odds times this many words.
TRUSTED = 20
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def bounded_sample(rows: DataFrame, by: str, id_col: str, most: int, seed: int = 5, weight: str | None = None) -> DataFrame:
    """About ``most`` rows for each value of ``by`` (all, if fewer), chosen by a hash of the id and the row's place. ``weight``: name of
    a column with the number of rows that a sampled one stands for, the inverse of its value's sampling share."""
    sizes = rows.groupBy(by).count().withColumn("share", F.lit(float(most)) / F.col("count")).drop("count")
    found = sizes.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {by}: these are no labels")
    shares = F.broadcast(rows.sparkSession.createDataFrame(found, sizes.schema))
    draw = (F.xxhash64(F.lit(seed), id_col, F.monotonically_increasing_id()).cast("double") / F.lit(2.0**64)) + 0.5
    drawn = rows.join(shares, by).where(draw < F.col("share"))
    return (drawn.withColumn(weight, F.greatest(F.lit(1.0), 1 / F.col("share"))) if weight else drawn).drop("share")


def count_grams(sample: DataFrame) -> pd.DataFrame:
    """lang, n (0: word), gram, count: the most frequent of each language and n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            rows: Counter = Counter()
            for lang, found in words.items():
                for word, times in found.items():
                    rows[lang, 0, word] += times
                    for n in range(1, LONGEST + 1):
                        for gram in grams_of(word, n):
                            rows[lang, n, gram] += times
            keys = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()),
                                              pa.array(rows.values(), pa.int64())], names=["lang", "n", "gram", "times"])

    counts = sample.select("lang", "text").mapInArrow(lean(count), "lang string, n int, gram string, times long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    total = F.sum("times").over(Window.partitionBy("lang", "n")).alias("total")
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")).alias("place")
    kept = counts.select("*", total, place).where(F.col("place") <= F.when(F.col("n") == 0, WORDS).otherwise(GRAMS))
    return kept.drop("place").toPandas()  # at most LANGUAGES x (WORDS + LONGEST x GRAMS) rows


class Model:
    """Log frequencies: ``known`` maps a word (or n-gram, by length) to its row of ``table``; columns are ``languages``."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        column = {lang: i for i, lang in enumerate(self.languages)}
        self.known: list[dict[str, int]] = []
        self.table: list[np.ndarray] = []
        for n in range(LONGEST + 1):
            part = counts[counts["n"] == n]
            grams = {g: i for i, g in enumerate(sorted(part["gram"].unique()))}
            times, totals = np.zeros((len(grams), len(column))), np.zeros(len(column))
            col = part["lang"].map(column).to_numpy(dtype=np.int64)
            times[part["gram"].map(grams).to_numpy(dtype=np.int64), col] = part["times"].to_numpy()
            totals[col] = part["total"].to_numpy()
            self.known.append(grams)
            self.table.append(np.log((times + 0.5) / (totals + 0.5 * max(1, len(grams)))).astype(np.float32))

    def rows(self, word: str) -> tuple[int, list[int]]:
        """Where the word stands: its n (0: as a word) and rows of that table; no rows if nothing of it is known."""
        row = self.known[0].get(word)
        if row is not None:
            return 0, [row]
        for n in range(LONGEST, 0, -1):
            rows = [r for g in grams_of(word, n) if (r := self.known[n].get(g)) is not None]
            if rows:
                return n, rows
        return 0, []

    def word(self, word: str) -> np.ndarray:
        return self.score(*self.rows(word))

    def score(self, n: int, rows: list[int]) -> np.ndarray:
        if not rows:
            return np.zeros(len(self.languages), np.float32)
        return self.table[n][rows].mean(axis=0) if n else self.table[0][rows[0]]


class Predictor:
    """Scores texts; remembers the scores of up to ``CACHE`` words."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.scores = np.zeros((CACHE, len(model.languages)), np.float32)
        self.tells = np.zeros(CACHE, bool)

    def _places(self, words: list[str]) -> list[int]:
        place = self.place
        new = [w for w in set(words) if w not in place]
        if len(place) + len(new) > len(self.scores):
            place.clear()
            new = set(words)
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), self.scores.shape[1]), np.float32)
                self.tells = np.zeros(len(new), bool)
        for w in new:
            n, rows = self.model.rows(w)
            self.scores[len(place)] = self.model.score(n, rows)
            self.tells[len(place)] = has_letter(w) and (bool(rows) or len(self.model.languages) < 2)
            place[w] = len(place)
        return [place[w] for w in words]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and the number of words that tell: those with a letter of which the model knows as much as a letter, or
        all with a letter where fewer than two languages were learned."""
        words = words_of(text) if text else []
        if not self.model.languages:
            return UNKNOWN, 0.0, sum(map(has_letter, words))
        if not any(map(has_letter, words)):
            return UNKNOWN, 0.0, 0
        places = self._places(words)
        total = self.scores[places].sum(axis=0, dtype=np.float64)
        odds = np.exp((total - total.max()) * (min(len(words), TRUSTED) / len(words)))
        best = int(total.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum()), int(self.tells[places].sum())


def train(labelled: DataFrame, *, id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from (id, text, lang) rows; rows without text or lang are left out."""
    rows = labelled.where("text is not null and lang is not null").select(id_col, "text", "lang")
    return Model(count_grams(bounded_sample(rows, "lang", id_col, rows_per_language)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out`` (lang_pred, score, told: its words that tell)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, told long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget_kept()
        predictor = Predictor(shared.value)
        try:
            for texts in batches:
                yield pd.DataFrame([predictor.judge(t) for t in texts], columns=["lang_pred", "score", "told"])
        finally:
            del predictor
            release_memory()

    # It is deterministic; marked otherwise, so that a filter on the prediction is not pushed below it, to predict twice.
    return docs.withColumn(out, predict.asNondeterministic()(F.col(text_col).cast("string")))


def drop_unidentified(docs: DataFrame, model: Model, lang_col: str | None = None) -> DataFrame:
    """``docs`` without those of no language, by ``identify`` of their whole texts: no letter, or no word of which the model knows as
    much as a letter. A text that is short or mixed stays however level the languages are in it; where fewer than two were learned,
    all texts with letters stay. ``lang_col``: a string column whose nulls become the predicted language."""
    found = identify(docs, model, out="__li").where("__li.told > 0")
    if lang_col is not None:
        found = found.withColumn(lang_col, F.coalesce(F.col(lang_col), F.nullif("__li.lang_pred", F.lit(UNKNOWN))))
    return found.drop("__li")


def held_out(parts: int, part: int):
    """Whether crc32 of the id as text leaves remainder ``part``; an id that is null does not, nor is it learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part


def predicted_languages(docs: DataFrame) -> DataFrame:
    """The digest of op1."""
    model = train(docs.where(~held_out(4, 2)))
    rows = docs.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score")
