"""Exact top-k by inner product with a pivot table.

Inner product becomes distance: with |x'| = M for all rows (one more component sqrt(M^2 - |x|^2)) and 0 in that place for a query,
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The distances of every row to a fixed number of pivots are computed once and stored with it. For a
query, |d(q', p) - d(x', p)| is a lower bound of the distance for each pivot p, the greatest of them bounds the score from above, and
rows are evaluated in the order of that bound until no bound left reaches the k-th score found.

Distinct vectors are searched, each with its smallest ids (see ``distinct_vectors``). Rows are tiles of bounded size near one pivot, queries are tiles too: a
stated query set against all rows, in blocks. Queries start with the k-th score among a bounded sample of rows. Which tiles they can reach is found from the
tiles' pivot intervals alone, which are kept apart from the vectors, many tiles to a directory row; only pairs of tiles that some query
reaches are given their vectors and searched. Scores are integers, exact in doubles below 2^53.

Cases: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of the same length are compared; equal scores go by
the smaller id; rows that repeat an id and vector count once; with fewer than k candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import join_staged, stage
from sieve.llm.vectors import distinct_vectors, expand, finite, matrix, top_rows

PIVOTS, SAMPLE = 32, 1024
ROW_TILE, QUERY_TILE, STEP = 4096, 256, 128
#: Row tiles whose pivot intervals one directory row holds.
DIRECTORY = 256


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice: each pivot is the sampled vector farthest from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]


def query_bounds(q: np.ndarray, pivots: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to the pivots, |q|^2 + M^2, and by how much bounds are raised: rounding of the distances must never hide a row."""
    norm = (q * q).sum(1) + top
    return distances(np.c_[q, np.zeros(len(q))], pivots), norm, 1e-9 * norm + 1e-6


def reached(to_pivots: np.ndarray, norm: np.ndarray, slack: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, tiles): whether a tile, whose rows lie between ``low`` and ``high`` (tiles, pivots) from the pivots, may hold a score of ``floor`` or more."""
    gap = np.zeros((len(to_pivots), len(low)))
    for j in range(to_pivots.shape[1]):
        d = to_pivots[:, j, None]
        np.maximum(gap, np.maximum(low[None, :, j] - d, d - high[None, :, j]), out=gap)
    return (norm[:, None] - gap * gap) / 2 + slack[:, None] >= floor[:, None]


def search_tile(q: np.ndarray, q_ids, floor: np.ndarray, x: np.ndarray, table: np.ndarray, ids: list, pivots: np.ndarray, top: float, k: int):
    """(query id, vec id, score) of the rows of one tile that may be among the k best of each query."""
    to_pivots, norm, slack = query_bounds(q, pivots, top)
    reach = reached(to_pivots, norm, slack, floor, table.min(0)[None], table.max(0)[None])[:, 0]
    out = []
    for i in np.flatnonzero(reach):
        bound = (norm[i] - (np.abs(table - to_pivots[i]).max(1)) ** 2) / 2 + slack[i]
        order = np.flatnonzero(bound >= floor[i])
        order = order[np.argsort(-bound[order], kind="stable")]
        scores, rows, least = np.zeros(0), np.zeros(0, np.int64), floor[i]
        for at in range(0, len(order), STEP):
            part = order[at:at + STEP]
            if bound[part[0]] < least:
                break
            scores, rows = np.concatenate([scores, x[part] @ q[i]]), np.concatenate([rows, part])
            if len(scores) > k + 1:  # one of them may be the query itself
                firsts = np.fromiter((ids[r][0] for r in rows), np.int64, len(rows))
                best = np.lexsort((firsts, -scores))[:k + 1]
                scores, rows = scores[best], rows[best]
                least = max(least, scores[-1])
        query = int(q_ids[i])
        out += [(query, v, int(round(s))) for s, v in expand(query, scores, [ids[r] for r in rows], k)]
    return out


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``rows`` and ``queries`` (id: long, vec: array<double> of whole numbers) -> query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
                     F.array_sort(F.collect_set(F.size("vec"))).alias("dims")).first()
    schema = "query_id long, vec_id long, score long"
    index = stage(distinct_vectors(rows, facts["n"], k + 1), "distinct-vectors")
    found = None
    for dim in facts["dims"] or []:
        part = _search(index.where(F.size("vec") == dim), queries.where(F.size("vec") == dim), facts["top"] or 0.0, k, schema)
        found = part if found is None else found.unionByName(part)
    return top_rows(found if found is not None else spark.createDataFrame([], schema), k)


def _search(index: DataFrame, queries: DataFrame, top: float, k: int, schema: str) -> DataFrame:
    spark = index.sparkSession
    sample = np.array([r["vec"] for r in index.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()], np.float64)
    shared = spark.sparkContext.broadcast((sample, pick_pivots(lifted(sample, top), PIVOTS)))  # bounded by SAMPLE and PIVOTS

    def nearest_pivot(extra):
        """Task function: rows with their distances to the pivots and the number of the nearest; ``extra`` gives the lifted component."""
        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"))
                table = distances(extra(x), shared.value[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(table), pa.list_(pa.float64())), pa.array(table.argmin(1).astype(np.int32))],
                                                 names=[*batch.schema.names, "table", "near"])
        return near

    rows = index.mapInArrow(nearest_pivot(lambda x: lifted(x, top)), "vec array<double>, ids array<long>, table array<double>, near int")
    placed, n_tiles = _numbered(stage(rows, "pivot-table"), ROW_TILE)
    asked = queries.select("id", "vec").mapInArrow(nearest_pivot(lambda q: np.c_[q, np.zeros(len(q))]), "id long, vec array<double>, table array<double>, near int")
    asked, _ = _numbered(stage(asked, "query-pivots"), QUERY_TILE)

    def pack_rows(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, d = matrix(t.column("vec").chunk(0)), matrix(t.column("table").chunk(0))
        packed = {"tile": t.column("tile")[:1], "x": [x.tobytes()], "d": [d.tobytes()], "low": [d.min(0).tobytes()], "high": [d.max(0).tobytes()], "ids": [t.column("ids").to_pylist()]}
        return pa.table(packed, schema=pa.schema([("tile", pa.int64()), *[(n, pa.binary()) for n in ("x", "d", "low", "high")], ("ids", pa.list_(pa.list_(pa.int64())))]))

    def pack_queries(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q, sample = matrix(t.column("vec").chunk(0)), shared.value[0]
        scores = q @ sample.T
        # The (k + 1)-th score in the sample, as one of the sampled may be the query itself.
        floor = -np.partition(-scores, k, axis=1)[:, k] if scores.shape[1] > k else np.full(len(q), -np.inf)
        bounds = np.c_[np.stack([floor, *query_bounds(q, shared.value[1], top)[1:]], axis=1), matrix(t.column("table").chunk(0))]
        return pa.table({"part": t.column("tile")[:1], "q": [q.tobytes()], "floor": [floor.tobytes()], "bounds": [bounds.tobytes()], "q_ids": [t.column("id").to_pylist()]},
                        schema=pa.schema([("part", pa.int64()), ("q", pa.binary()), ("floor", pa.binary()), ("bounds", pa.binary()), ("q_ids", pa.list_(pa.int64()))]))

    def pack_directory(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        whole = [b"".join(t.column(n).to_pylist()) for n in ("low", "high")]
        return pa.table({"dir": t.column("dir")[:1], "low": whole[:1], "high": whole[1:], "tiles": [t.column("tile").to_pylist()]},
                        schema=pa.schema([("dir", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("tiles", pa.list_(pa.int64()))]))

    tiled = stage(placed.groupBy("tile").applyInArrow(pack_rows, "tile long, x binary, d binary, low binary, high binary, ids array<array<long>>"), "row-tiles")
    asked = stage(asked.groupBy("tile").applyInArrow(pack_queries, "part long, q binary, floor binary, bounds binary, q_ids array<long>"), "query-tiles")
    directory = tiled.select(F.expr(f"tile div {DIRECTORY}").alias("dir"), "tile", "low", "high").groupBy("dir")
    directory = directory.applyInArrow(pack_directory, "dir long, low binary, high binary, tiles array<long>")
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_tiles - 1) // DIRECTORY).cast("long"))
    tested = asked.select("part", "bounds", F.explode(every).alias("dir")).join(stage(directory, "tile-directory"), "dir")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[1])
        for batch in batches:
            for i in range(batch.num_rows):
                bounds, low, high = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("bounds", "low", "high"))
                bounds = bounds.reshape(-1, n + 3)
                some = reached(bounds[:, 3:], bounds[:, 1], bounds[:, 2], bounds[:, 0], low.reshape(-1, n), high.reshape(-1, n)).any(0)
                tiles = np.array(batch.column("tiles")[i].as_py(), np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tiles), batch.column("part")[i].as_py())), pa.array(tiles)], names=["part", "tile"])

    pairs = stage(tested.mapInArrow(reach, "part long, tile long"), "reached-tiles")
    pairs = join_staged(join_staged(pairs, asked.drop("bounds"), ["part"], "inner"), tiled.drop("low", "high"), ["tile"], "inner")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value[1]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                floor, ids = np.frombuffer(row["floor"].as_buffer()), row["ids"].as_py()
                q, x, d = (np.frombuffer(row[n].as_buffer()).reshape(m, -1) for n, m in (("q", len(floor)), ("x", len(ids)), ("d", len(ids))))
                hits = search_tile(q, row["q_ids"].as_py(), floor, x, d, ids, pivots, top, k)
                cols = list(zip(*hits, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(search, schema)


def _numbered(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with the number of their tile: of about ``size`` rows, all near one pivot; and the number of tiles."""
    tiles = F.ceil(F.col("count") / size)
    upto = F.sum(tiles).over(Window.orderBy("near").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = stage(rows.groupBy("near").count().select("near", tiles.alias("tiles"), (upto - tiles).alias("base")), "tiles")  # a row per pivot
    number = (F.col("base") + F.pmod(F.xxhash64("vec"), F.col("tiles"))).cast("long")
    return rows.join(F.broadcast(first), "near").withColumn("tile", number), first.agg(F.sum("tiles")).first()[0] or 0


def scaled_topk(embeddings: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """The digest of op8: queries are the rows whose vec_id is divisible by ``every``, against all rows."""
    rows = embeddings.where(finite("embedding") & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").alias("id"),
                       F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("vec"))
    return exact_topk(rows, rows.where(F.col("id") % every == 0).dropDuplicates(["id", "vec"]), k)
