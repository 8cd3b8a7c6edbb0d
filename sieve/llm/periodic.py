"""Periodic runs of words: suffix automaton with link-cut access.

A run is a maximal stretch of words with smallest period q that is at least ``times`` periods and ``least`` words long.

For a stretch of words the suffix automaton is built; its suffix links form a tree in which the prefix ending at word i is a node, and the
path from that node to the root holds all suffixes of the prefix. The tree is kept as a link-cut tree whose preferred paths are
coloured by the last prefix end that visited them. Appending word i accesses the path of its prefix: it passes a few coloured
segments, each of which says that its longest suffix, of ``length`` words, was last seen ending at ``colour``, and recolours all of them
with i. The distance d = i - colour is then the smallest period of the last ``length + d`` words: a square where length >= d. The same start
and period come again with every further word of the run, so the last end seen for a (start, period) is the run's end.

What is searched: in a run of at least 24 words and 3 periods every eight consecutive words recur in the document. Eight-word shingles
are hashed with numpy, a batch of documents at a time, and only stretches all of whose shingles recur go to the automaton. A run
lies in one such stretch whole, and a stretch's runs are runs of the document, so this loses and adds nothing; hash collisions only make
a stretch longer. The automaton takes about a kilobyte a word of the longest stretch, the rest a few times the batch of texts.

Cases: a null or empty text, or one of white space, has no words and no runs; null and repeated ids are kept; an empty table gives an
empty result; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import forget_kept, lean
from sieve.llm.tokens import slices

#: Words of the shingles whose recurrence is tested; runs of 3 periods and 24 words allow nine at most.
SHINGLE = 8
RUNS = "array<struct<start: long, length: long, period: long>>"


def suffix_automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state, and the state of each prefix. State 1 is the root, 0 none."""
    follow, link, length, ends, last = [{}, {}], [0, 0], [0, 0], [], 1
    for word in words:
        new = len(link)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at:
            old = follow[at][word]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(link)
                follow.append(dict(follow[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                link[old] = link[new] = copy
                while at and follow[at].get(word) == old:
                    follow[at][word] = copy
                    at = link[at]
        last = new
        ends.append(new)
    return link, length, ends


class PathTree:
    """A rooted tree as a link-cut tree: each preferred path is a splay tree by depth, with one colour, kept at its root."""

    def __init__(self, link: list[int]):
        self.up, n = list(link), len(link)  # parent in the splay tree, or, of a splay root, the tree node above its path
        self.above, self.below, self.colour = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int, p: int) -> None:
        up, above, below = self.up, self.above, self.below
        g = up[p]
        if g and above[g] == p:
            above[g] = x
        elif g and below[g] == p:
            below[g] = x
        else:
            self.colour[x] = self.colour[p]  # p was the root
        if above[p] == x:
            inner = above[p] = below[x]
            below[x] = p
        else:
            inner = below[p] = above[x]
            above[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        while (p := up[x]) and (above[p] == x or below[p] == x):
            g = up[p]
            if g and (above[g] == p or below[g] == p):
                if (above[g] == p) == (above[p] == x):
                    self._rotate(p, g)
                else:
                    self._rotate(x, p)
                    p = g
            self._rotate(x, p)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Make the path from ``node`` to the root one path of this colour. Returns (deepest node, colour) of the visited segments it had."""
        passed, x, under = [], node, 0
        while x:
            self._splay(x)
            rest = self.below[x]
            if rest:
                self.colour[rest] = self.colour[x]  # what lies deeper keeps its colour
            if self.colour[x] >= 0:
                passed.append((x, self.colour[x]))
            self.below[x] = under
            under, x = x, self.up[x]
        self.colour[under] = colour
        return passed


def word_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    link, length, ends = suffix_automaton(words)
    tree, last = PathTree(link), {}
    for i, node in enumerate(ends):
        for deepest, before in tree.access(node, i):
            period, seen = i - before, length[deepest]
            if seen >= (times - 1) * period and seen + period >= least:
                last[i + 1 - seen - period, period] = i
    return sorted((start, end + 1 - start, period) for (start, period), end in last.items())


def repeated_stretches(marks: np.ndarray, sizes: np.ndarray, least: int = 24) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``least`` words or more in which every eight words recur in their document.

    ``marks``: a 64-bit mark of each word, documents one after the other; ``sizes``: words of each document."""
    if len(marks) < least:
        return []
    grams, step = marks.astype(np.uint64), 1
    while step < SHINGLE:
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + np.roll(grams, -step)
        grams ^= grams >> np.uint64(29)
        step *= 2
    ends = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    grams ^= document.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.flatnonzero(np.arange(len(marks)) + SHINGLE <= ends[document])
    grams = grams[whole]
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    low = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[twice & low] = True
    mine = np.flatnonzero(maybe[grams & low])
    place = np.minimum(np.searchsorted(twice, grams[mine]), len(twice) - 1)
    again = whole[mine[twice[place] == grams[mine]]]
    cuts = np.flatnonzero(np.diff(again) > 1)
    first, final = again[np.r_[0, cuts + 1]], again[np.r_[cuts, len(again) - 1]] + SHINGLE
    long = final - first >= least
    return list(zip(first[long].tolist(), final[long].tolist(), strict=True))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def text_runs(docs: DataFrame, *, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text",
              edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, ``runs`` (by start, then period) and ``collapsed``, the words without those any run repeats after
    its first period, joined by a space. ``edit`` (id, words) may change a document's words first."""
    if times < 3 or least < 24:
        raise ValueError("times must be 3 or more and least 24 or more: only then does every shingle of a run recur")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            for at, rows in slices(batch.column(1)):
                ids = batch.column(0).slice(at, rows)
                texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in batch.column(1).slice(at, rows)]
                if edit is not None:
                    texts = [edit(i, words) for i, words in zip(ids.to_pylist(), texts, strict=True)]
                sizes = np.array([len(words) for words in texts], np.int64)
                flat = [w for words in texts for w in words]
                marks = np.fromiter(map(hash, flat), np.int64, len(flat))
                begins = np.cumsum(sizes) - sizes
                runs: list[list] = [[] for _ in texts]
                for begin, end in repeated_stretches(marks, sizes, least):
                    doc = int(np.searchsorted(begins, begin, "right")) - 1
                    while not sizes[doc]:
                        doc -= 1
                    runs[doc] += [(begin - int(begins[doc]) + s, n, p) for s, n, p in word_runs(flat[begin:end], least, times)]
                for found in runs:
                    found.sort()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(sizes), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], kind),
                    pa.array([_collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lean(find), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The input of op11: the words of one document in ten, by its id's checksum, are periodic from some place on."""
    if doc_id is None or not words:
        return words
    mark, n = zlib.crc32(str(doc_id).encode()), len(words)
    if mark % 10:
        return words
    rest = mark // 10
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    root = words[start:start + period]
    return words[:start] + [root[i % period] for i in range(n - start)]


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the first in the array. Null if there is none."""
    least = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, least, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def periodic_documents(docs: DataFrame) -> DataFrame:
    """The digest of op11: doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and the two checksums; n_words."""
    found = text_runs(docs, edit=planted).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
