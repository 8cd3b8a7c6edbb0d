"""Values carried along an order within a key, where one key may hold a third of the rows.

A window over a key sorts the key's rows in one task. Here rows are range-partitioned by key and order instead, so a hot key is cut
into as many cells (key and partition) as its rows need, even where all its rows share one moment. Three steps follow: a
window inside each cell; one summary row per cell; and a window over the summaries of a key, which hands each cell what the
cells before (or after) it hold. The last window sees a row per partition that a key reaches into, never its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.skew import join_groups
from sieve.staging import stage

CELL, PLACE = "__cell", "__place"


def in_cells(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows``, written, with the number of their cell: cells of a key rise with ``order``. Equal rows are told apart by their place."""
    placed = rows.withColumn(PLACE, F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, *order, PLACE).withColumn(CELL, F.spark_partition_id())
    return stage(placed, "cells")


def window_in_cell(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CELL).orderBy(*order, PLACE)


def carried(rows: DataFrame, keys: list[str], summaries: dict[str, Column], before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """``rows`` (of ``in_cells``) with a column for each of ``before`` and ``after``.

    ``summaries`` are aggregates over a cell; ``before`` and ``after`` are aggregates over the summaries of the key's earlier and
    later cells, null where there is none."""
    cells = rows.groupBy(*keys, CELL).agg(*[e.alias(n) for n, e in summaries.items()])
    order = Window.partitionBy(*keys).orderBy(CELL)
    behind, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    found = cells.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], F.col(CELL).alias("__cn"),
                         *[e.over(behind).alias(n) for n, e in before.items()], *[e.over(ahead).alias(n) for n, e in after.items()])
    on = [*[(k, f"__c{i}") for i, k in enumerate(keys)], (CELL, "__cn")]
    return join_groups(rows, found, on, "left", null_safe=True)
