"""What both vector searches share: which vectors count, copies of a vector, and exact top-k rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for


def finite(col: str) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~bad


def distinct_vectors(rows: DataFrame, count: int, keep: int) -> DataFrame:
    """``rows`` (id, vec) -> (vec, ids): each distinct vector once with its ``keep`` smallest ids, ascending.

    No search for k neighbours can return more than k of the copies of one vector, nor any but those with the smallest ids. Ids are gathered by
    vector and hash part first, so that a vector that a third of all rows share is not gathered in one place."""
    parts = buckets_for(count, least=16)
    some = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    some = some.agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"))
    return some.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1 if n else 0)


def expand(query: int, scores: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of some distinct vectors and their ids, without the query's own id; ties to the smaller id."""
    found = sorted((-s, i) for s, own in zip(scores.tolist(), ids, strict=True) for i in own if i != query)
    return [(-s, i) for s, i in found[:k]]


def top_rows(found: DataFrame, k: int) -> DataFrame:
    """``found`` (query_id, vec_id, score) -> the k best of each query with rank, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
