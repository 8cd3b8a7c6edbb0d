"""Lines that many documents share (DataFrame functions only).

Every line becomes an occurrence of two 64-bit hashes of its key, its document's mark and its position; no text is shuffled for them.
Occurrences are range-partitioned by hash and, within one hash, by document, so that a line that a third of all documents hold is dealt to
as many tasks as any other rows, and sorted by hash, document and position. A pass over each sorted run streams the first occurrence
of a key in each document; counting those per key is a partial aggregate. The decision about a key comes back as a bitmap per document:
words of 64 lines, those left out in which every line stays. Texts meet only the bitmaps, by document.

A document's mark is 128 bits of hash over its id and text, so it is the same in every scan, however the files are split. Rows
that repeat both id and text count as documents of their own and share a bitmap.

Cases: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` always stay; null ids are kept; if all lines go the
text is empty; an empty table gives an empty result; other columns pass through ``drop_lines`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import join_staged, stage

#: ASCII white space, and the letters that keys have in lower case.
SPACE, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARK = ("__ld_a", "__ld_b")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _hashes(*cols: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits in two columns. Hashing skips nulls, so what may be null comes with its null flag."""
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in zip((1, 2), names, strict=True)]


def _marks(id_col: str, text_col: str) -> list[Column]:
    ident, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    return _hashes(ident.isNull(), ident, text.isNull(), text, names=MARK)


def line_occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """A row per line whose key has ``min_chars`` code points: the key's hashes h and g, the document's mark and the line's number."""
    lines = docs.select(*_marks(id_col, text_col), F.posexplode(_lines(text_col)).alias("pos", "line"))
    lines = lines.select(*MARK, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select(*_hashes(F.col("key"), names=("h", "g")), *MARK, "pos")


def common_keys(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """Keys (h, g) that ``min_docs`` documents or more hold, their number of documents, and their first place (mark and line)."""
    ordered = occurrences.repartitionByRange("h", "g", *MARK)
    # Equal rows of a document (its copies) have equal rank: each copy has its first occurrence.
    run = Window.partitionBy("h", "g", *MARK).orderBy("pos")
    firsts = ordered.withColumn("at", F.rank().over(run)).where("at = 1")
    keys = firsts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(*MARK, "pos")).alias("first"))
    return keys.where(F.col("n_docs") >= min_docs)


def line_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document mark that loses a line: ``kept``, an array of (word, bits) by word. Bit i of word w is line 64 w + i; it is set if that line stays.
    Words and documents that are left out lose nothing.

    keep: ``none`` drops every line of a common key; ``first`` keeps its first place, by document mark (the order of a hash, so any document is
    as likely to keep it; rows that repeat id and text are one there) and position."""
    if keep not in ("none", "first"):
        raise ValueError("keep: none or first")
    occurrences = stage(line_occurrences(docs, id_col=id_col, text_col=text_col, min_chars=min_chars), "line-occurrences")
    common = stage(common_keys(occurrences, min_docs), "line-keys")
    gone = join_staged(occurrences, common, ["h", "g"], "inner")
    if keep == "first":
        gone = gone.where(F.struct(*MARK, "pos") != F.col("first"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = gone.groupBy(*MARK, F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = words.groupBy(*MARK).agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("kept"))
    return stage(packed, "line-bitmaps")


def _dense(kept: Column) -> Column:
    """The bitmap with its left-out words up to the last it holds."""
    before = lambda i: F.when(i > 0, kept[i - 1]["word"]).otherwise(F.lit(-1))
    return F.flatten(F.transform(kept, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(i) - 1), F.array(w["bits"]))))


def kept_lines(lines: Column, kept: Column) -> Column:
    """The lines that a bitmap keeps. Both are bound once, so each line costs one look at the bitmap."""
    bound = F.struct(lines.alias("lines"), _dense(kept).alias("bits"))

    def stays(x: Column):
        return lambda _, i: F.getbit(F.coalesce(F.get(x["bits"], F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1

    return F.transform(F.array(bound), lambda x: F.filter(x["lines"], stays(x)))[0]


def _judged(docs: DataFrame, *, id_col: str, text_col: str, **options) -> DataFrame:
    """``docs`` with ``__ld_kept``, the bitmap (null where no line goes)."""
    bitmaps = line_bitmaps(docs, id_col=id_col, text_col=text_col, **options).withColumnRenamed("kept", "__ld_kept")
    return join_staged(docs.select("*", *_marks(id_col, text_col)), bitmaps, list(MARK)).drop(*MARK)


def drop_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that many documents share; texts that lose none, nulls among them, are as they were."""
    judged = _judged(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, keep=keep)
    text = F.when(F.col("__ld_kept").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(kept_lines(_lines(text_col), F.col("__ld_kept")), "\n"))
    return judged.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_dedup_documents(docs: DataFrame) -> DataFrame:
    """The digest of op12: doc_id, n_lines, n_dropped, kept_sha256 (a null text counts as empty)."""
    judged = _judged(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), id_col="doc_id", text_col="text")
    kept = F.col("__ld_kept")
    text = F.when(kept.isNull(), F.col("text")).otherwise(F.array_join(kept_lines(_lines("text"), kept), "\n"))
    dropped = F.aggregate(kept, F.lit(0).cast("long"), lambda n, w: n + 64 - F.bit_count(w["bits"]))
    return judged.select("doc_id", F.size(_lines("text")).cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
                         F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
