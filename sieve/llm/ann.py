"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Largest inner product becomes smallest Euclidean distance: rows are scaled by the greatest norm M of their band and lifted to the unit sphere
by one more component, sqrt(1 - |x|^2 / M^2), queries are scaled to length 1 with 0 in that place. Bands are ranges of norms, so that one long vector does not
press all others together; vectors of even norms form one band. A table hashes a vector to the integer parts of K projections (a.x + b) / w with
Gaussian a. A query looks into its own bucket of every band and then into buckets with projections moved to a neighbouring value, in the order of their
estimated success: the sum of the squared distances to the boundaries crossed, smallest first; most combinations of moves are never
visited. The candidates of all tables are merged and ranked by their exact inner product on the original vectors, in double precision.

Every row is indexed. Equal vectors are indexed once with their smallest ids (see ``distinct_vectors``), large buckets are cut into tiles, and
the queries of a bucket too, so no task holds more than a tile of each. Pairs of tiles are found from their names alone, and a row tile meets its queries
by its own name, so tasks grow with the rows and not with the buckets. There is no cap on a bucket's candidates. A query that finds fewer than k is
run against all rows, tile by tile. Vectors of single precision are kept as such until they are scored.

Parameters: unless a ``Hashing`` is given, ``fitted`` chooses tables, projections, width and probes on at most SAMPLE rows and ASKED queries: of the settings whose recall there
reaches RECALL the one of least cost, which counts scored pairs, copies of vectors and lost neighbours, so that more projections are taken as rows grow. On vectors without structure (the test tables:
evenly spread directions in 64 dimensions) any hashing must look at most rows for a recall of 0.9; clustered vectors reach it with a fraction of them.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; only vectors of the same length are compared; equal scores
go by the smaller id; rows that repeat an id and vector count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import join_staged, stage
from sieve.llm.vectors import distinct_vectors, expand, finite, matrix, top_rows

ROW_TILE, QUERY_TILE = 8192, 256
# The sample the parameters are fitted on, the recall they must reach there, the pairs that could be scored in the time one copy of a vector takes,
# and what a lost neighbour costs (all of them: as much as scoring every pair so many times).
SAMPLE, ASKED, RECALL, COPY, LOSS = 2048, 128, 0.96, 500, 20
BANDS = [0.999, 0.99, 0.95, 0.8, 0.5]  # quantiles of the norms a band may begin at
SHAPES = ((5, 3, 12), (8, 4, 30), (10, 6, 60))  # tables, projections, probes
WIDTHS = [round(0.3 * 1.15 ** i, 3) for i in range(16)]
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``projections`` projections each, bucket width ``width`` (distances lie between 0 and 2), ``probes`` buckets a table."""

    tables: int = 5
    projections: int = 2
    width: float = 0.8
    probes: int = 9
    seed: int = 17

    def drawn(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.tables, dim + 1, self.projections)), rng.uniform(0, 1, (self.tables, self.projections))

    def values(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, tables, projections): where each projection falls, in bucket widths."""
        a, b = self.drawn(lifted.shape[1] - 1)
        return np.einsum("nd,tdk->ntk", lifted, a) / self.width + b

    def cells(self, table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """One number for a table (or band and table) and bucket; should two buckets share one, their rows are candidates of both."""
        out = table.astype(np.uint64) + np.uint64(1)
        for k in range(buckets.shape[-1]):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ buckets[..., k].astype(np.int64).view(np.uint64)
            out ^= out >> np.uint64(29)
        return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def row_cells(self, x: np.ndarray, tops: list[float]) -> np.ndarray:
        """(rows, tables): the cells of rows. ``tops``: the greatest norm of each band, falling."""
        norm = np.sqrt((x * x).sum(1))
        band = np.maximum((norm[:, None] <= np.array(tops)[None]).sum(1) - 1, 0)
        x = x / np.array(tops)[band][:, None]
        buckets = np.floor(self.values(np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))])).astype(np.int64)
        return self.cells(band[:, None] * self.tables + np.arange(self.tables)[None], buckets)

    def query_cells(self, q: np.ndarray, bands: int) -> list[np.ndarray]:
        """The cells each query looks into."""
        values = self.values(np.c_[q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))])
        buckets = np.floor(values).astype(np.int64)
        probed = buckets[:, :, None] + offsets((values - buckets).reshape(-1, self.projections), self.probes).reshape(len(q), self.tables, -1, self.projections)
        # (queries, bands, tables, probes)
        marks = np.arange(bands)[:, None] * self.tables + np.arange(self.tables)[None]
        cells = self.cells(np.broadcast_to(marks[None, :, :, None], (len(q), bands, *probed.shape[1:3])), probed[:, None])
        return [np.unique(c) for c in cells]


def moves(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """Bucket offsets in the order of estimated success, the own bucket first. ``inside``: a query's places within its bucket (0 to 1).

    The 2K single moves are sorted by squared distance to their boundary. Sets of moves come off a heap, each one followed by itself with its last move replaced by the
    next and by itself with the next added; sets that move a projection both ways are passed over."""
    k = len(inside)
    cost = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    which, step, cost = order % k, np.where(order < k, -1, 1), cost[order]
    out, heap = [np.zeros(k, np.int64)], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if len({which[j] for j in chosen}) == len(chosen):
            offset = np.zeros(k, np.int64)
            for j in chosen:
                offset[which[j]] = step[j]
            out.append(offset)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def offsets(inside: np.ndarray, probes: int) -> np.ndarray:
    """The first ``probes`` of ``moves`` for every row of ``inside``: (rows, probes, K). Few projections: all combinations are ranked at once."""
    k = inside.shape[1]
    if 3 ** k > 729 or not len(inside):
        return np.array([moves(row, probes) for row in inside], np.int64).reshape(len(inside), min(probes, 3 ** k), k)
    every = np.array(list(itertools.product((0, -1, 1), repeat=k)), np.int64)
    cost = inside ** 2 @ (every == -1).T + (1 - inside) ** 2 @ (every == 1).T
    return every[np.argsort(cost, axis=1, kind="stable")[:, :probes]]


def band_tops(top: float, starts: list[float]) -> list[float]:
    """Greatest norms of the bands: ``top``, and of the quantiles (falling) those well below the one before."""
    tops = [top]
    for start in starts:
        if 0 < start < 0.8 * tops[-1]:
            tops.append(start)
    return tops


def fitted(x: np.ndarray, q: np.ndarray, n_rows: int, n_queries: int, tops: list[float], k: int) -> Hashing:
    """The best setting by sampled rows and queries: of those that find RECALL of the neighbours the one of least cost, or the one that finds most if none does.

    Cost: pairs scored and copies made, as a share of scoring every pair, and LOSS times the share of neighbours lost, so that recall is bought where it is cheap.
    Of a query's k neighbours among all rows a sample holds its share, at least one; so many are looked for. The least width that
    suffices is found by halving, as wider buckets hold more; the two above it are tried as well."""
    wanted, score = max(1, -(-k * len(x) // max(1, n_rows))), q @ x.T
    for i, query in enumerate(q):
        score[i, (x == query).all(1)] = -np.inf  # its own vector
    best = np.argsort(-score, axis=1, kind="stable")[:, :wanted]
    tried = {}

    def lost(shape: tuple[int, int, int], width: int) -> float:
        """The share of neighbours that a setting loses."""
        tables, projections, probes = shape
        hashing = Hashing(tables, projections, WIDTHS[width], probes)
        if hashing not in tried:
            cells = hashing.row_cells(x, tops)
            met = np.array([np.isin(cells, own).sum(1) for own in hashing.query_cells(q, len(tops))])
            copies = COPY * (n_queries * len(tops) * tables * probes + n_rows * tables)
            misses = 1 - float((np.take_along_axis(met, best, 1) > 0).mean())
            tried[hashing] = misses, float(met.mean()) + copies / (n_rows * n_queries) + LOSS * misses
        return tried[hashing][0]

    for shape in SHAPES:
        least = bisect.bisect_left(range(len(WIDTHS)), True, key=lambda w, shape=shape: lost(shape, w) <= 1 - RECALL)
        for width in range(least, min(least + 3, len(WIDTHS))):
            lost(shape, width)
    enough = {h: cost for h, (misses, cost) in tried.items() if misses <= 1 - RECALL}
    return min(enough or tried, key=lambda h: enough[h] if enough else tried[h])


def score_tiles(q: np.ndarray, q_ids: list[int], x: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """The k best rows of a tile for each query. The matrix product only chooses: every row that reaches its (k + 1)-th score (one may
    be the query itself) but for rounding. Their scores are summed again in one fixed order, so that a pair has the same score in
    every tile it meets, and ties are cut by the smaller id."""
    rough = q @ x.T
    last = max(0, len(x) - k - 1)
    # Both sums of a pair are off by at most dim x eps x |q| |x| each, and so are those of the row at the threshold.
    slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    least = np.partition(rough, last, axis=1)[:, last] - slack
    firsts = np.array([own[0] for own in ids], np.int64)
    out = []
    for i, query in enumerate(q_ids):
        rows = np.flatnonzero(rough[i] >= least[i])
        scores = (x[rows] * q[i]).sum(axis=1)
        best = np.lexsort((firsts[rows], -scores))[:k + 1]
        out += [(query, v, s) for s, v in expand(query, scores[best], [ids[r] for r in rows[best]], k)]
    return out


def _tile(kind: str, columns: tuple[str, str, str], dtype: type):
    """Group function: the rows of a tile -> one row with their vectors packed and their ids."""
    name, cell, part = columns
    inner = pa.list_(pa.int64())
    schema = pa.schema([(cell, pa.int64()), (part, pa.int64()), (f"{name}_vec", pa.binary()), (f"{name}_ids", pa.list_(inner) if kind == "rows" else inner)])

    def tile(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return pa.table([t.column("cell")[:1], t.column("part")[:1], pa.array([matrix(t.column("vec").chunk(0), dtype).tobytes()], pa.binary()),
                         pa.array([t.column("ids" if kind == "rows" else "id").to_pylist()], schema.field(3).type)], schema=schema)

    ids = "array<array<long>>" if kind == "rows" else "array<long>"
    return tile, f"{cell} long, {part} long, {name}_vec binary, {name}_ids {ids}"


def _tiles(rows: DataFrame, kind: str, size: int, dtype: type) -> DataFrame:
    """``rows`` (vec, cells, ids or id) -> tiles of at most about ``size`` rows of a cell, their vectors packed as ``dtype``."""
    own = "ids" if kind == "rows" else "id"
    apart = rows.select(F.explode("cells").alias("cell"), "vec", own)
    sizes = stage(apart.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("parts")), "cell-sizes")
    key = F.pmod(F.xxhash64("vec", *(["id"] if kind == "queries" else [])), F.col("parts")).cast("long")
    placed = join_staged(apart, sizes, ["cell"], "inner").select("cell", key.alias("part"), "vec", own)
    function, schema = _tile(kind, ("x" if kind == "rows" else "q", "cell", "x_part" if kind == "rows" else "q_part"), dtype)
    return stage(placed.groupBy("cell", "part").applyInArrow(function, schema), f"{kind}-tiles")


def _scored(pairs: DataFrame, k: int, dtype: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = batch.column("q_ids")[i].as_py(), batch.column("x_ids")[i].as_py()
                q, x = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype).astype(np.float64).reshape(n, -1) for c, n in (("q_vec", len(q_ids)), ("x_vec", len(ids))))
                cols = list(zip(*score_tiles(q, q_ids, x, ids, k), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                                 names=["query_id", "vec_id", "score"])

    return pairs.select("q_vec", "q_ids", "x_vec", "x_ids").mapInArrow(run, FOUND)


def _search(index: DataFrame, queries: DataFrame, tops: list[float], k: int, hashing: Hashing, dtype: type) -> DataFrame:
    """Found rows for vectors of one length; ``tops``: the greatest norms of the bands."""

    def row_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashing.row_cells(matrix(batch.column("vec")), tops)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    def query_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashing.query_cells(matrix(batch.column("vec")), len(tops))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    vec = index.schema["vec"].dataType.simpleString()
    rows = stage(index.mapInArrow(row_cells, f"vec {vec}, ids array<long>, cells array<long>"), "row-cells")
    asked = stage(queries.mapInArrow(query_cells, f"id long, vec {vec}, cells array<long>"), "query-cells")
    tiles, asking = _tiles(rows, "rows", ROW_TILE, dtype), _tiles(asked, "queries", QUERY_TILE, dtype)
    names = tiles.select("cell", "x_part").join(asking.select("cell", "q_part"), "cell")
    pairs = names.join(asking, ["cell", "q_part"]).join(tiles, ["cell", "x_part"])
    found = stage(_scored(pairs, k, dtype).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")
    # Queries that found too few go through all rows: the tiles of one table hold each row once.
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = stage(asked.join(enough, "id", "left_anti"), "short-queries")
    n_short = short.count()
    if not n_short:
        return found
    one = _tiles(rows.withColumn("cells", F.slice("cells", 1, 1)), "rows", ROW_TILE, dtype)
    one = stage(one.withColumn("tile", F.row_number().over(Window.orderBy("cell", "x_part")) - 1), "numbered-tiles")  # a row per tile
    last = max(0, one.count() - 1)
    parts = F.array(F.pmod(F.xxhash64("id"), F.lit(max(1, n_short // QUERY_TILE))))
    every = F.explode(F.sequence(F.lit(0), F.lit(last)))
    again = _tiles(short.withColumn("cells", parts), "queries", QUERY_TILE, dtype).drop("cell").withColumn("tile", every).join(one, "tile")
    return found.unionByName(_scored(again, k, dtype)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` vectors, the same ones in every run."""
    return np.array([r["vec"] for r in rows.orderBy(F.xxhash64("vec"), "vec").limit(size).collect()], np.float64)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, hashing: Hashing | None = None) -> DataFrame:
    """``rows`` and ``queries`` (id: long, vec: array<double>) -> query_id, rank, vec_id, score."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    single = F.every(F.forall("vec", lambda x: x.cast("float").cast("double") == x)).alias("single")
    rows, queries = rows.where(square > 0), queries.where(square > 0)
    norms = F.percentile_approx(F.sqrt(square), BANDS, 10_000).alias("starts")
    facts = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("top"), norms, single).orderBy("dim").collect()
    asked = {r["dim"]: r for r in queries.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), single).collect()}
    dtype = np.float32 if all(r["single"] for r in [*facts, *asked.values()]) else np.float64
    if dtype is np.float32:
        rows, queries = (t.withColumn("vec", F.col("vec").cast("array<float>")) for t in (rows, queries))
    index, found = stage(distinct_vectors(rows, sum(r["n"] for r in facts), k + 1), "distinct-vectors"), None
    for fact in (r for r in facts if r["dim"] in asked):
        own, asking = (t.where(F.size("vec") == fact["dim"]) for t in (index, queries))
        tops, use = band_tops(fact["top"], fact["starts"]), hashing
        if use is None:
            use = fitted(_sample(own, SAMPLE), _sample(asking, ASKED), fact["n"], asked[fact["dim"]]["n"], tops, k)
        part = _search(own, asking, tops, k, use, dtype)
        found = part if found is None else found.unionByName(part)
    return top_rows(found if found is not None else rows.sparkSession.createDataFrame([], FOUND), k)


def nearest_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The digest of op2: queries are the rows whose vec_id is divisible by ``every``, against all rows."""
    rows = embeddings.where(finite("embedding") & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return nearest(rows, rows.where(F.col("id") % every == 0).dropDuplicates(["id", "vec"]), k)
