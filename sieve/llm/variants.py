"""Spelling variants of words: blocked Gram matrices.

Two words are near if one code point inserted, deleted or replaced makes one of the other. With a word's code points counted by
class (letters, as far as the classes tell them apart), near words lie within a squared distance of two: one for an insertion, two for a
replacement by another class, none for one within a class. A NumPy product of the count matrices of two blocks of words gives all
squared distances between them; pairs at most two apart are verified letter by letter.

Blocks: the classes are dealt to a few groups, and a block holds the words with the same number of code points in each group (so of
one length). Near words lie in one block or in blocks whose counts differ by one in one group (adjacent lengths) or by one up and one down in
two (equal lengths); each such pair of blocks that exists is compared once, no others. Blocks are cut into tiles of bounded size, by a
hash, so a hot block is many tasks; what is dealt out is pairs of tiles. A pair of tiles returns a row per word that has a near one: their
number and the best of them, not the pairs.

More words are spread over more groups, so that blocks stay small; the result does not depend on it.

Cases: null texts have no words; a null id leaves a document's words as they are; an empty table gives an empty result; other columns are not read; repeated rows
are documents of their own; a word of any length is compared whole (counts are exact up to 2**26 code points a class).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import forget_kept, join_staged, lean, stage

#: Classes of code points: by remainder, which tells a-z and most of Latin-1 apart.
CLASSES = 96
#: Words of a tile (about), pairs verified at once, and counted words a task holds before it passes them on.
TILE, CHECKED, HELD = 2048, 1 << 20, 1 << 19
#: The longest word whose squared letter counts are exact in single precision.
SINGLE = 2048


def letter_runs(docs: DataFrame, *, least: int = 7, id_col: str = "doc_id", text_col: str = "text", damage: int = 31) -> DataFrame:
    """(word, n): how often each run of letters a-z and U+00C0-U+00FF occurs, A-Z in lower case, if it has ``least`` code points.

    ``damage``: runs of a document whose checksum with its id this divides lose the code point the checksum names (0: none do)."""
    run = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(run.findall(text.as_buffer().to_pybytes().lower().decode()))  # of bytes: A-Z only
                if damage and ident is not None:
                    prefix = zlib.crc32(f"{ident}:".encode())
                    for word, n in found.items():
                        mark = zlib.crc32(word.encode(), prefix)
                        if mark % damage == 0:
                            at = mark % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least:
                            total[word] += n
                else:
                    total.update(found)
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def groups_for(words: int) -> int:
    """Groups of classes: as many as leave blocks of about a hundred words (three for a hundred thousand words, eleven for fifty million)."""
    return max(3, round(1.4 * math.log(max(1, words) / 20_000)))


def group_of(codes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each code point's class: classes are mixed first, as the vowels lie at like distances."""
    return codes % CLASSES * 37 % 97 % groups


def neighbours(groups: int) -> list[list[int]]:
    """Differences between the group counts of near words, one of each pair of opposites."""
    steps = [[0] * groups]
    for g in range(groups):
        steps.append([int(g == i) for i in range(groups)])
    for g, h in permutations(range(groups), 2):
        if g < h:
            steps.append([int(g == i) - int(h == i) for i in range(groups)])
    return steps


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, one after the other, and each word's number of them."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.array([len(w) for w in words], np.int64)


def _tiles(words: DataFrame, groups: int, tile: int) -> DataFrame:
    """(block, tile, length, codes, n): ``block`` is the array of group counts; the tile's words, of one length, by code point order,
    as code points (a byte each if all are below 256, else four), and their counts (int64)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = _codes(batch.column(0).to_pylist())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(owner * groups + group_of(codes, groups), minlength=len(sizes) * groups).reshape(-1, groups)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(counts.ravel().astype(np.int32)))],
                                             names=["word", "n", "block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column("words"):
                codes, sizes = _codes(held.values.field("word").to_pylist())
                narrow = "u1" if codes.max(initial=0) < 256 else "<u4"
                out.append((int(sizes[0]), codes.astype(narrow).tobytes(), held.values.field("n").to_numpy(zero_copy_only=False).astype("<i8").tobytes()))
            length, codes, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("tile"), pa.array(length, pa.int32()), pa.array(codes, pa.binary()),
                                              pa.array(n, pa.binary())], names=["block", "tile", "length", "codes", "n"])

    marked = stage(words.select("word", "n").mapInArrow(mark, "word string, n long, block array<int>"), "variant-blocks")
    sizes = stage(marked.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "variant-sizes")
    cut = join_staged(marked, sizes, ["block"], "inner")
    cut = cut.withColumn("tile", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / tile)).cast("int"))
    tiles = cut.groupBy("block", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words"))
    return stage(tiles.mapInArrow(pack, "block array<int>, tile int, length int, codes binary, n binary"), "variant-tiles")


class Block:
    """The words of a tile (all of one length): code points, counts by class, and n."""

    def __init__(self, codes: bytes, n: bytes, length: int):
        self.n, self.length = np.frombuffer(n, "<i8"), length
        rows = len(self.n)
        self.codes = np.frombuffer(codes, "u1" if len(codes) == rows * length else "<u4").reshape(rows, length)
        owner = np.repeat(np.arange(rows), length)
        counts = np.bincount(owner * CLASSES + self.codes.ravel().astype(np.int64) % CLASSES, minlength=rows * CLASSES).reshape(-1, CLASSES)
        self.counts = counts.astype(np.float32 if length <= SINGLE else np.float64)
        self.norms = (self.counts * self.counts).sum(axis=1)
        self.held = self.counts.any(axis=0)

    @classmethod
    def of(cls, words: list[str], n: list[int] | None = None) -> Block:
        codes, sizes = _codes(words)
        return cls(codes.astype("<u4").tobytes(), np.array(n or [0] * len(words), "<i8").tobytes(), int(sizes[0]))

    def words(self, places: np.ndarray) -> list[str]:
        return [x.astype("<u4").tobytes().decode("utf-32-le") for x in self.codes[places]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points, whether exactly one edit makes a of b; b is as long as a, or shorter by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead, behind = a[:, :-1] == b, a[:, 1:] == b
    n = b.shape[1]
    lead = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1)) if n else np.zeros(len(a), np.int64)
    trail = np.where(behind.all(axis=1), n, behind[:, ::-1].argmin(axis=1)) if n else np.zeros(len(a), np.int64)
    return lead + trail >= n


def near_pairs(x: Block, y: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the near words of two blocks; each pair once where the blocks are the same."""
    a, b, turned = (x, y, False) if x.length >= y.length else (y, x, True)
    if a.length - b.length > 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = [], []
    both, one = a.held & b.held, np.ones  # classes that only one block has do not enter the product
    side = np.c_[b.counts[:, both], one(len(b.norms), b.counts.dtype), b.norms].T
    step = max(1, CHECKED // len(b.norms))
    for lo in range(0, len(a.norms), step):
        part = slice(lo, lo + step)
        apart = np.c_[-2 * a.counts[part][:, both], a.norms[part], one(len(a.norms[part]), a.counts.dtype)] @ side
        i, j = np.divmod(np.flatnonzero(apart <= 2), len(b.norms))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), max(1, CHECKED // max(1, a.length))):
            cut = slice(at, at + max(1, CHECKED // max(1, a.length)))
            good = one_edit(a.codes[i[cut]], b.codes[j[cut]])
            left.append(i[cut][good])
            right.append(j[cut][good])
    i, j = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (left, right))
    return (j, i) if turned else (i, j)


def _best(mine: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place in ``mine``: it, its number of pairs, and the other with the largest n, of equals the first."""
    order = np.lexsort((other, -n[other], mine))
    mine, other = mine[order], other[order]
    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
    return mine[first], np.diff(np.r_[first, len(mine)]), other[first]


def near_words(words: DataFrame, rows: int, *, tile: int = TILE, groups: int | None = None) -> DataFrame:
    """Per word that has a near one: word, n_near, near (the one of largest n, of equals the smallest) and near_n. ``words``: distinct word, n."""
    groups = groups or groups_for(rows)
    tiles = _tiles(words, groups, tile)
    places = tiles.select("block", "tile")
    steps = F.array(*[F.array(*[F.lit(d) for d in step]) for step in neighbours(groups)])
    reach = places.withColumn("step", F.explode(steps)).select(
        F.col("block").alias("a"), F.col("tile").alias("s"), F.zip_with("block", "step", lambda x, d: x + d).alias("b"))
    pairs = reach.join(places.select(F.col("block").alias("b"), F.col("tile").alias("t")), "b")
    pairs = stage(pairs.where((F.col("a") != F.col("b")) | (F.col("s") <= F.col("t"))).select("a", "s", "b", "t"), "variant-pairs")
    side = lambda k, p: tiles.select(F.col("block").alias(k), F.col("tile").alias(p), *[F.col(c).alias(f"{c}_{k}") for c in ("length", "codes", "n")])
    dealt = join_staged(join_staged(pairs, side("a", "s"), ["a", "s"], "inner"), side("b", "t"), ["b", "t"], "inner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        key, kept = None, None  # rows come by their second tile
        for batch in batches:
            for row in range(batch.num_rows):
                same, codes, n, length = (batch.column(c)[row] for c in ("same", "codes_b", "n_b", "length_b"))
                if (codes.as_buffer(), n.as_buffer()) != key:
                    key = codes.as_buffer(), n.as_buffer()
                    kept = Block(codes.as_py(), n.as_py(), length.as_py())
                y = kept
                x = y if same.as_py() else Block(*(batch.column(c)[row].as_py() for c in ("codes_a", "n_a", "length_a")))
                i, j = near_pairs(x, y, x is y)
                both = [(np.r_[i, j], np.r_[j, i], x, x)] if x is y else [(i, j, x, y), (j, i, y, x)]
                for mine, other, own, theirs in both:
                    if len(mine):
                        at, count, best = _best(mine, other, theirs.n)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(own.words(at), pa.string()), pa.array(count.astype(np.int64)), pa.array(theirs.words(best), pa.string()),
                            pa.array(theirs.n[best].astype(np.int64))], names=["word", "n_near", "near", "near_n"])

    dealt = dealt.select(((F.col("a") == F.col("b")) & (F.col("s") == F.col("t"))).alias("same"), *[f"{c}_{k}" for c in ("length", "codes", "n") for k in "ab"])
    found = dealt.mapInArrow(lean(compare), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(join_staged(now, ahead, ["root"]).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                      "variant-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def spelling_variants(words: DataFrame, *, ratio: int = 10, tile: int = TILE, groups: int | None = None) -> DataFrame:
    """``words`` (distinct word, n) with form (the near word of largest n, if that is ``ratio`` times the word's or more), root, n_near and form_n."""
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    near = stage(near_words(words, words.count(), tile=tile, groups=groups), "variant-near")
    known = join_staged(words, near, ["word"])
    fits = F.col("near_n") >= F.col("n") * ratio
    judged = stage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "variant-forms")
    ends = stage(roots(judged.where(F.col("form").isNotNull())), "variant-ends")
    return join_staged(judged, ends, ["word"]).select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, *, least: int = 7, occurrences: int = 2, ratio: int = 10) -> DataFrame:
    """The digest of op13: word, form, root, n, n_near, form_n."""
    return spelling_variants(letter_runs(docs, least=least).where(F.col("n") >= occurrences), ratio=ratio)
