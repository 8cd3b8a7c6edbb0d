"""Packing documents into training sequences by minimum bin slack.

Documents are encoded in parallel and cut into pieces of ``capacity`` ids and one shorter tail. What the
packing needs of all tails is their histogram: one count for each length below the capacity, whatever the
size of the corpus. From it ``plan`` fills windows: the longest remaining tail is set, a bitset subset-sum (bit s: some
multiset of remaining lengths sums to s) finds the sum closest to the room left, and the counts of that multiset
are traced back. A multiset found is used for as many windows at once as the counts allow, so the plan has some thousand
lines for any number of documents. Where no multiset fills a window, the room left is filled by the head of a further tail,
whose rest goes back to the histogram; so all sequences but the last are full.

Tails are then numbered within their length (distributed: by hash bucket and bucket offset, so that a length with a
third of all tails is spread), and number and length give each its sequence and offset by a search in the plan.

Cases: null and empty texts are the end id alone; repeated rows are separate documents; a null doc_id stays null;
an empty table gives no piece; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for, lean, release_memory, stage
from sieve.llm.tokens import Encoder, default_tokenizer, slices, with_end

PIECES = "uid long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def cut_pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece. ``ids`` (little-endian uint32) is kept for tails, which may be cut again, or for all pieces."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid = Encoder.of(tokenizer), TaskContext.get().partitionId() << 40
        try:
            for batch in batches:
                for made in cut_batch(batch, encoder, uid):
                    uid += made.num_rows
                    yield made
        finally:  # a later stage need not stand beside this one's pieces
            encoder.rest()
            release_memory()

    def cut_batch(batch: pa.RecordBatch, encoder: Encoder, uid: int) -> Iterator[pa.RecordBatch]:
        for at, rows in slices(batch.column(1)):
            ids, sizes = with_end(*encoder.encode(batch.column(1).slice(at, rows)), end_id)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(rows), pieces)
            start = capacity * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(sizes[doc] - start, capacity)
            begin = (ends - sizes)[doc] + start
            parts = [raw[4 * a:4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(uid + np.arange(len(doc))), batch.column(0).slice(at, rows).take(pa.array(doc)),
                pa.array(start), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                pa.array(sizes[doc].astype(np.int64)),
                pa.array([bytes(p) if keep_ids or len(p) < 4 * capacity else None for p in parts], pa.binary()),
            ], names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            uid += len(doc)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fill(room: int, stock: dict[int, int]) -> dict[int, int]:
    """The multiset of ``stock`` (length -> count) whose sum is closest to ``room`` from below, long lengths first.

    Bit s of ``reach`` says that some multiset sums to s; counts enter as 1, 2, 4, ... copies. The reach before
    each step is kept, and the target is traced back: a step was used where the target was not in reach before it."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in stock if x <= room), reverse=True):
        left, copies = min(stock[length], room // length), 1
        while left:
            take = min(copies, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room:
            break
    target, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + take
            target -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int = 1024) -> tuple[np.ndarray, int]:
    """Where each tail goes, and the number of sequences. Rows: tail length, first number, count, start in the tail, length taken,
    place of the first in its step, copies per sequence, first sequence, first offset."""
    stock = {n: deque([(n, 0, c, 0)]) for n, c in histogram.items() if c}
    counts = {n: int(c) for n, c in histogram.items() if c}
    lines, sequences = [], 0

    def take(length: int, number: int):
        """Runs of tails, ``number`` in all, of those now ``length`` long."""
        counts[length] -= number
        while number:
            origin, first, held, start = stock[length].popleft()
            part = min(held, number)
            if part < held:
                stock[length].appendleft((origin, first + part, held - part, start))
            yield origin, first, part, start
            number -= part
        if not counts[length]:
            del counts[length], stock[length]

    while counts:
        anchor = max(counts)
        rest = {n: c - (n == anchor) for n, c in counts.items() if c > (n == anchor)}
        used = best_fill(capacity - anchor, rest)
        used[anchor] = used.get(anchor, 0) + 1
        times = min(counts[n] // c for n, c in used.items())
        room, cut = capacity - sum(n * c for n, c in used.items()), None
        if room:
            spare = [n for n, c in counts.items() if n > room and c > used.get(n, 0)]
            if spare:
                cut = max(spare)
                times = min(times, counts[cut] // (used.get(cut, 0) + 1))
            elif sum(counts.values()) > sum(used.values()):
                times = 1
        offset = 0
        for length in sorted(used, reverse=True):
            place = 0
            for origin, first, part, start in list(take(length, used[length] * times)):
                lines.append((origin, first, part, start, length, place, used[length], sequences, offset))
                place += part
            offset += length * used[length]
        if cut:
            place = 0
            for origin, first, part, start in list(take(cut, times)):
                lines.append((origin, first, part, start, room, place, 1, sequences, offset))
                place += part
                stock.setdefault(cut - room, deque()).append((origin, first, part, start + room))
                counts[cut - room] = counts.get(cut - room, 0) + part
        sequences += times
    return np.array(lines, np.int64).reshape(-1, 9), sequences


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``number``, 0, 1, ... within their length."""
    keyed = pieces.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(buckets_for(rows, least=64))))
    counts = keyed.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("length", "b").orderBy("uid")
    return keyed.join(offsets, ["length", "b"]).withColumn("number", F.col("off") + F.row_number().over(within) - 1).drop("b", "off")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if kept)."""
    pieces = stage(cut_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col,
                              keep_ids=keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    lines, _ = plan(histogram, capacity)
    order = np.lexsort((lines[:, 1], lines[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(lines[order])
    wide = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        low = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "ids_crc32", "number")}
            key = col["length"].astype(np.int64) * wide + col["number"]
            by = np.argsort(key, kind="stable")
            a, b = np.searchsorted(key[by], low), np.searchsorted(key[by], low + table[:, 2])
            hits = np.flatnonzero(b > a)
            line = np.repeat(hits, (b - a)[hits])
            row = by[np.arange(len(line)) - np.repeat(np.cumsum((b - a)[hits]) - b[hits], (b - a)[hits])]
            t = table[line]
            at = t[:, 5] + col["number"][row] - t[:, 1]
            crc, ids = col["ids_crc32"][row].astype(np.int64), batch.column("ids")
            cut = np.flatnonzero(t[:, 4] < col["length"][row])
            held = {i: ids[int(row[i])].as_py()[4 * int(t[i, 3]):4 * int(t[i, 3] + t[i, 4])] for i in cut.tolist()}
            for i, part in held.items():
                crc[i] = zlib.crc32(part)
            take = pa.array(row)
            out = [batch.column("doc_id").take(take), pa.array(col["start"][row] + t[:, 3]), pa.array(t[:, 4]), pa.array(crc),
                   batch.column("doc_tokens").take(take), pa.array(t[:, 7] + at // t[:, 6]), pa.array(t[:, 8] + at % t[:, 6] * t[:, 4])]
            if keep_ids:
                out.append(pa.array([held.get(i, ids[j].as_py()) for i, j in enumerate(row.tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return numbered(pieces, sum(histogram.values())).mapInArrow(lean(place), schema)


def sequences(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """The sequences themselves (``pack(..., keep_ids=True)``): sequence_id, ids (binary, little-endian uint32, zero padded to the
    capacity unless the length is a power of two), doc_ids in order. A sequence has ``capacity`` pieces at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"),
                                              F.sum("length").alias("n"))
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    exact = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    padded = F.when(exact, ids).otherwise(F.rpad(ids, 4 * capacity, F.lit(b"\x00")))
    return parts.select("sequence_id", padded.alias("ids"), F.col("n").alias("length"), F.col("p.doc_id").alias("doc_ids"))
