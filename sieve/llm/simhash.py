"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each. Every distinct fingerprint emits all its
variants within r bits, variants are shuffled, and fingerprints that share one collide. Any two fingerprints that share
a variant are within 2r bits of each other, so a colliding set is a clique: it is linked by a star around its smallest member (each
link still verified by its bit distance), never by all its pairs, and no connection is lost.

Volume: with r = 2 there are 2,081 variants of 64 bits. They are made with numpy, dealt out as packed runs (8 bytes a variant and
2 for its mask, no row for each), and in passes over disjoint parts of the variant space: eight, so that an eighth of them
is on disk at a time, and more where the cells of a pass would outgrow their bound. Cell and pass are linear in the bits (cell(x ^ m) = cell(x) ^ cell(m)): a pass makes just its own variants, and the variants of
fingerprints that resemble each other are spread over all cells.

Cases: null and empty texts, and texts without words, have fingerprint 0 and link like any other; exact copies have equal fingerprints
and meet before any variant is made; null doc_ids are kept, and do not name a component unless all its ids are null; repeated rows are separate documents; an
empty table gives an empty result; very long texts are hashed in runs of bounded size.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import forget_kept, join_staged, lean, scratch_path, stage
from sieve.llm.components import components

SEED = 42
RUN = 1 << 15
#: At least 2**3 passes of at most 2**16 cells each.
PASS_BITS, CELL_BITS = 3, 16
#: Variants that one reducing task should hold (10 bytes each, and as much again to sort them).
CELL_VARIANTS = 1 << 20
CHUNK = 4096


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles: bit b is set if it is in over half the XXH64 hashes."""
    words = data.lower().split()  # of bytes: A-Z only; ASCII white space
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, RUN):
        hashes = np.array([digest(b" ".join(words[i:i + shingle]), SEED) for i in range(lo, min(lo + RUN, n))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = 4, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            marks = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in batch.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(marks.view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("__text"), *keep)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(run), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long")


def ball(radius: int) -> np.ndarray:
    """XOR masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)], np.uint64)


def cell_table(bits: int) -> np.ndarray:
    """A linear map of 64 bits to ``bits``: [byte place, byte value] -> cell; the cell of a word is the XOR over its bytes."""
    columns = np.random.default_rng(SEED).integers(0, 1 << bits, (8, 8), dtype=np.uint32)
    values = np.arange(256)
    table = np.zeros((8, 256), np.uint32)
    for bit in range(8):
        table ^= np.where(values >> bit & 1, columns[:, bit:bit + 1], 0).astype(np.uint32)
    return table


def cells_of(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint32)
    for place in range(8):
        out ^= table[place][(words >> np.uint64(8 * place)) & np.uint64(255)]
    return out


def _dealt(masks: np.ndarray, pass_bits: int, cell_bits: int, part: int):
    """Task function of one pass: fingerprints -> (cell, variants, masks) runs."""
    table = cell_table(pass_bits + cell_bits)
    mask_cells = cells_of(masks, table)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), CHUNK):
                fps = every[lo:lo + CHUNK]
                fp_cells = cells_of(fps, table)
                values, which, cells = [], [], []
                groups = fp_cells >> cell_bits
                for group in np.unique(groups).tolist():
                    mine = np.flatnonzero(groups == group)
                    use = np.flatnonzero(mask_cells >> cell_bits == group ^ part)
                    values.append((fps[mine][:, None] ^ masks[use][None, :]).ravel())
                    cells.append(((fp_cells[mine][:, None] ^ mask_cells[use][None, :]) & ((1 << cell_bits) - 1)).astype(np.uint16).ravel())
                    which.append(np.tile(use.astype(np.uint16), len(mine)))
                values, which, cells = np.concatenate(values), np.concatenate(which), np.concatenate(cells)
                order = np.argsort(cells, kind="stable")
                values, which = values[order], which[order]
                ends = np.cumsum(np.bincount(cells, minlength=1 << cell_bits))
                runs = [(c, int(ends[c - 1]) if c else 0, int(ends[c])) for c in range(1 << cell_bits)]
                runs = [r for r in runs if r[2] > r[1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([c for c, _, _ in runs], pa.int32()), pa.array([values[a:b].tobytes() for _, a, b in runs], pa.binary()),
                    pa.array([which[a:b].tobytes() for _, a, b in runs], pa.binary())], names=["cell", "variants", "masks"])

    return deal


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for links within one cell."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _collide(masks: np.ndarray, max_bits: int):
    """Group function: the runs of a cell -> links (a, b), a forest over its colliding fingerprints."""

    def collide(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("variants")])
        which = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("masks")])
        ordered = np.sort(values)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(shared):
            return empty
        low = np.uint64((1 << 20) - 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[shared & low] = True
        mine = np.flatnonzero(maybe[values & low])
        place = np.minimum(np.searchsorted(shared, values[mine]), len(shared) - 1)
        hit = shared[place] == values[mine]
        mine, place = mine[hit], place[hit]
        owner = values[mine] ^ masks[which[mine]]
        order = np.lexsort((owner, place))
        place, owner = place[order], owner[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        centre = np.repeat(owner[first], np.diff(np.r_[first, len(place)]))
        link = np.bitwise_count(centre ^ owner)
        link = (link > 0) & (link <= max_bits)
        nodes, index = np.unique(np.concatenate([centre[link], owner[link]]), return_inverse=True)
        if not len(nodes):
            return empty
        half = len(index) // 2
        root = _roots(index[:half], index[half:], len(nodes))
        far = root != np.arange(len(nodes))
        return pa.table({"a": nodes[root[far]].view(np.int64), "b": nodes[far].view(np.int64)})

    return collide


def bits_for(variants: int) -> tuple[int, int]:
    """Bits that name the pass and the cell, so that a cell holds about ``CELL_VARIANTS`` variants however many there are."""
    bits = max(PASS_BITS + 6, (variants // CELL_VARIANTS).bit_length())
    return max(PASS_BITS, bits - CELL_BITS), min(CELL_BITS, bits - PASS_BITS)


def ball_links(points: DataFrame, rows: int, max_bits: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (``fp``) with a chain of steps of at most ``max_bits`` bits."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: only then do all that share a variant lie within it")
    spark, masks = points.sparkSession, ball(max_bits // 2)
    pass_bits, cell_bits = bits_for(rows * len(masks))
    tasks = max(1, min(-(-rows // CHUNK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows >> 18)))
    path = scratch_path(spark, "ball-links")
    for part in range(1 << pass_bits):
        runs = points.select("fp").repartition(tasks).mapInArrow(lean(_dealt(masks, pass_bits, cell_bits, part)), "cell int, variants binary, masks binary")
        runs.groupBy("cell").applyInArrow(_collide(masks, max_bits), "a long, b long").distinct().write.parquet(f"{path}/pass={part}")
        # Spark drops a shuffle's files once its plan is garbage on the driver; the next pass needs the room.
        del runs
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema("a long, b long").option("recursiveFileLookup", "true").parquet(path)


def near_duplicates(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (doc_id among them), ``fp``, ``root`` (the component's smallest fingerprint), and ``component_id``: the
    smallest doc_id reachable."""
    marked = stage(fingerprints(docs, shingle=shingle, keep=keep), "fingerprints")
    points = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "points")
    links = ball_links(points, points.count(), max_bits)
    labels = stage(components(links).withColumnRenamed("node", "fp"), "labels")
    rooted = stage(join_staged(points, labels, ["fp"]).select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted")
    named = stage(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "named")
    classes = stage(join_staged(rooted, named, ["root"], "inner").select("fp", "root", "component_id"), "classes")
    return join_staged(marked, classes, ["fp"], "inner").select(*keep, "fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The digest of op3: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    found = near_duplicates(docs, shingle=shingle, max_bits=max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (rows that repeat it: one of them)."""
    # Numbered and written once, so that a row keeps its number; equal rows have numbers of their own.
    rows = stage(docs.withColumn("__nd_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, shingle=shingle, max_bits=max_bits, keep=("doc_id", "__nd_row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.col("__nd_row").alias("row")))
    kept = stage(found.groupBy("root").agg(best.alias("k")).select(F.col("k.row").alias("__nd_row")), "kept")
    return join_staged(rows, kept, ["__nd_row"], "inner").select(*docs.columns)
