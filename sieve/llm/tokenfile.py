"""Token files: Simple-8b words in blocks, written and read in parallel.

File layout (little-endian), one file per range of documents:

* header: ``TOK8`` and the version (uint32);
* blocks of ``BLOCK`` ids (the last may be shorter): the block's 64-bit words, then its escapes;
* index: doc ids (int64; null ids have their bit set in a mask), tokens per document (int64), and per block
  its byte offset, number of words, number of escapes and number of ids (int64 each);
* footer: number of documents, number of blocks, byte offset of the index (int64 each), ``TOK8``.

A word's top four bits select how many ids of how many bits its other 60 hold (``COUNTS``); two selectors
stand for runs of zeros. An id of more than 60 bits is an escape: selector 15, whose low bits number an entry of
the block's escape table. Every block starts at a known offset with a known count, so all blocks of a
file are encoded side by side, and decoded with one vectorised pass per selector.

A writing task names its files by attempt and returns their manifest row; the manifest is a written table,
so a lost executor or a speculative attempt leaves at most a file that nobody reads.

Cases: null or empty text is the end id alone; a null doc_id sorts first; repeated rows are separate
documents, ordered by text hash; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import as_uri, attempt_name, lean, open_input, open_output, release_memory, scratch_path, stage
from sieve.llm.tokens import BATCH_BYTES, Encoder, default_tokenizer, slices, with_end

MAGIC = b"TOK8"
BLOCK = 1024
#: Ids a word holds, by selector: two runs of zeros, then 60 // count bits each; 15 is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([0, 0, *(60 // COUNTS[2:15]), 60], np.int64)
ESCAPE = 15


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits each id needs (0 for 0)."""
    exact = np.uint64(1 << 53)
    if not len(ids) or ids.max() < exact:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high = ids >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def _widest(bits: np.ndarray) -> Iterator[np.ndarray]:
    """The widest of as many ids from each place on (255 past the end) as each selector holds, from one id to 240."""
    made = {1: bits}
    yield bits
    for count, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 3, 2), (6, 3, 3), (8, 4, 4), (10, 5, 5), (12, 6, 6), (15, 10, 5),
                        (20, 10, 10), (30, 15, 15), (60, 30, 30), (120, 60, 60), (240, 120, 120)):
        made[count] = np.full_like(bits, 255)
        np.maximum(made[a][:, :-a], made[b][:, a:], out=made[count][:, :-a])
        yield made[count]


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All words of all blocks in order, words per block, and each block's escapes (uint64)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    bits = _bits(grid).reshape(blocks, BLOCK)
    bits[-1, n - (blocks - 1) * BLOCK:] = 255
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    choice = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for sel, widest in zip(range(14, -1, -1), _widest(bits), strict=False):  # from few ids to many: the last that fits holds most
        fits = widest <= WIDTHS[sel]
        if not fits.any():
            break  # more ids of fewer bits fit nowhere either
        np.putmask(choice, fits, sel)
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    taken = np.full(blocks * BLOCK, -1, np.int8)  # the selector of the word that begins here
    while len(rows):
        begin = rows * BLOCK + at[rows]
        sel = choice.ravel()[begin]
        taken[begin] = sel
        at[rows] += COUNTS[sel]
        rows = rows[at[rows] < ends[rows]]
    start = np.flatnonzero(taken >= 0)
    row, sel = start // BLOCK, taken[start].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            held = grid[start[mine][:, None] + np.arange(COUNTS[s])]
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(held << shift, axis=1)
    per_block = np.bincount(row, minlength=blocks)
    escapes: list[np.ndarray] = [np.zeros(0, np.uint64)] * blocks
    out = np.flatnonzero(sel == ESCAPE)
    for b in np.unique(row[out]):
        mine = out[row[out] == b]
        words[mine] |= np.arange(len(mine), dtype=np.uint64)
        escapes[b] = grid[start[mine]]
    return words, per_block, escapes


def decode_words(words: np.ndarray, escapes: np.ndarray, first_escape: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks: ``escapes`` has their tables one after the other, ``first_escape`` the place
    of the table of each word's block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            held = (words[mine][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
            out[(ends[mine] - counts[mine])[:, None] + np.arange(COUNTS[s])] = held
    mine = np.flatnonzero(sel == ESCAPE)
    if len(mine):
        entry = (words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)
        out[ends[mine] - 1] = escapes[first_escape[mine] + entry]
    return out


class TokenWriter:
    """Writes one file; holds a run of ids of bounded size and the index."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint64)
        self._put(MAGIC + struct.pack("<I", 1))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes.astype(np.int64))
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK * BLOCK
        self.rest = ids[whole:]
        self._blocks(ids[:whole])

    def _blocks(self, ids: np.ndarray) -> None:
        words, per_block, escapes = encode_blocks(ids)
        if not len(per_block):
            return
        extra = np.array([len(e) for e in escapes], np.int64)
        size = 8 * (per_block + extra)
        held = np.full(len(per_block), BLOCK, np.int64)
        held[-1] = len(ids) - BLOCK * (len(held) - 1)
        self.blocks.append(np.stack([self.at + np.cumsum(size) - size, per_block, extra, held], axis=1))
        if extra.any():
            cuts = np.split(words, np.cumsum(per_block)[:-1])
            words = np.concatenate([x for pair in zip(cuts, escapes, strict=True) for x in pair])
        self._put(words.astype("<u8").tobytes())

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        blocks = np.concatenate([np.zeros((0, 4), np.int64), *self.blocks])
        index = self.at
        for x in (np.concatenate([np.zeros(0, np.int64), *self.docs]), sizes, blocks.T.ravel()):
            self._put(x.astype("<i8").tobytes())
        self._put(np.packbits(np.concatenate([np.zeros(0, bool), *self.nulls])).tobytes())
        self._put(struct.pack("<qqq", len(sizes), len(blocks), index) + MAGIC)
        self.sink.close()
        return len(sizes), int(sizes.sum())


def read_index(data) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, null mask, tokens per document and (blocks, 4) table of a file's bytes."""
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC or bytes(view[-4:]) != MAGIC:
        raise ValueError("not a token file")
    docs, blocks, at = struct.unpack("<qqq", view[-28:-4])
    ids = np.frombuffer(view, "<i8", docs, at)
    sizes = np.frombuffer(view, "<i8", docs, at + 8 * docs)
    table = np.frombuffer(view, "<i8", 4 * blocks, at + 16 * docs).reshape(4, blocks).T
    nulls = np.unpackbits(np.frombuffer(view, "u1", -(-docs // 8), at + 16 * docs + 32 * blocks), count=docs)
    return ids, nulls.astype(bool), sizes, table


def read_ids(data, table: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of a file: only the blocks that hold them are decoded."""
    a, b = lo // BLOCK, -(-hi // BLOCK)
    if b <= a:
        return np.zeros(0, np.uint64)
    part = table[a:b]
    begin, end = int(part[0, 0]), int(part[-1, 0] + 8 * (part[-1, 1] + part[-1, 2]))
    raw = np.frombuffer(memoryview(data), "<u8", (end - begin) // 8, begin)
    rel = (part[:, 0] - begin) // 8
    if part[:, 2].any():
        words = np.concatenate([raw[r:r + w] for r, w in zip(rel, part[:, 1], strict=True)])
        escapes = np.concatenate([raw[r + w:r + w + e] for r, w, e in zip(rel, part[:, 1], part[:, 2], strict=True)])
    else:
        words, escapes = raw, np.zeros(0, np.uint64)
    first = np.repeat(np.cumsum(part[:, 2]) - part[:, 2], part[:, 1])
    return decode_words(words, escapes, first)[lo - a * BLOCK:hi - a * BLOCK]


MANIFEST = "uri string, first_doc long, n_docs long, n_tokens long, part int, file int"


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 8 << 20) -> DataFrame:
    """Encode the texts in ascending id order into token files under ``path``; returns the manifest with ``start``,
    the ids in all files before. ``file_tokens`` bounds a file (but for one document that is longer)."""
    tokenizer = tokenizer or default_tokenizer()
    root = as_uri(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        writer, uri, held, made, first = None, "", 0, 0, None

        def done() -> pa.RecordBatch:
            n_docs, n_tokens = writer.close()
            return pa.RecordBatch.from_pylist([{"uri": uri, "first_doc": first, "n_docs": n_docs, "n_tokens": n_tokens,
                                                "part": part, "file": made}], schema=schema)

        try:
            for batch in batches:
                for at, rows in slices(batch.column(1), min(BATCH_BYTES, 2 * file_tokens)):
                    if writer is None:
                        uri = f"{root}/{attempt_name('tokens', f'-{made:05d}.tok8')}"
                        writer, held, first = TokenWriter(open_output(uri)), 0, batch.column(0)[at].as_py()
                    ids, sizes = with_end(*encoder.encode(batch.column(1).slice(at, rows)), end_id)
                    writer.add(batch.column(0).slice(at, rows), ids, sizes)
                    held += len(ids)
                    if held >= file_tokens:
                        yield done()
                        writer, made = None, made + 1
            if writer is not None:
                yield done()
        finally:
            encoder.rest()
            release_memory()

    schema = pa.schema([("uri", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                        ("part", pa.int32()), ("file", pa.int32())])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Repeated ids are cut apart by text hash, repeated rows by their place in the input, so that no range holds more than its share.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["uri"]) as f:
                    data = f.read()
                docs, nulls, sizes, table = read_index(data)
                ends = np.cumsum(sizes)
                crc = np.zeros(len(docs), np.int64)
                lo = 0
                while lo < len(docs):  # about a million ids at once, a document at least
                    base = int(ends[lo] - sizes[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
                    raw = memoryview(read_ids(data, table, base, int(ends[hi - 1])).astype("<u4").tobytes())
                    for i in range(lo, hi):
                        crc[i] = zlib.crc32(raw[4 * int(ends[i] - sizes[i] - base):4 * int(ends[i] - base)])
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=nulls), pa.array(row["start"] + ends - sizes),
                                                  pa.array(sizes), pa.array(crc)],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("uri", "start")
    dealt = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The digest of op10: write all documents to token files in the shared folder, then read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, tokenizer=tokenizer))
