"""Exact order statistics without putting a column into one task.

Spark's exact ``percentile`` / ``percentile_disc`` keep a map of every
distinct value, and a global aggregate merges those maps in a single task:
fine for a few million distinct values, fatal for a 100 TB column. So:

* one pass counts the non-NULL values and estimates the distinct count;
* if the distinct count is under ``distinct_limit`` the exact aggregates are
  used directly (one more pass);
* otherwise each wanted rank is bracketed with ``percentile_approx`` (rank
  error at most n/accuracy), the rows below each bracket are counted, and the
  search continues inside the brackets only. Every round shrinks the slice by
  about ``accuracy / 4``; once a slice is small its exact value is taken with
  ``percentile_disc``. All work stays in Spark jobs; only a handful of numbers
  per round reach the driver;
* where ties are so heavy that brackets stop shrinking, the values of the open bracket
  are counted each (a partial aggregate), range-partitioned, and the rank is found by
  the partitions' totals and a running sum in the one partition that holds it.

Ranks are 0-based positions in ascending order (NULL and NaN excluded).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.session import ensure_checkpoint_dir
from sieve.staging import stage

DISTINCT_LIMIT = 2_000_000
ACCURACY = 20_000
MAX_ACCURACY = 200_000  # keeps every percentile_approx sketch small


def clean_values(df: DataFrame, column: str) -> DataFrame:
    """The column as double ``v``, NULL and NaN removed."""
    v = F.col(column).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def count_and_distinct(values: DataFrame) -> tuple[int, int]:
    row = values.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v", 0.02).alias("d")).first()
    return int(row["n"]), int(row["d"] or 0)


def _disc(rank: int, m: int, lo: float | None = None, hi: float | None = None) -> Column:
    """Exact value at 0-based ``rank`` among the ``m`` values (within ``[lo, hi]`` if given).

    ``percentile_disc(p)`` returns the element at 1-based position ceil(p*m);
    p = (rank + 0.5) / m lands exactly on position rank + 1.
    """
    p = (rank + 0.5) / m
    arg = "v"
    if lo is not None:
        arg = (f"CASE WHEN v >= CAST('{lo!r}' AS DOUBLE) AND v <= CAST('{hi!r}' AS DOUBLE) "
               f"THEN v END")
    return F.expr(f"percentile_disc(CAST('{p!r}' AS DOUBLE)) WITHIN GROUP (ORDER BY {arg})")


def order_statistics(values: DataFrame, ranks: list[int], n: int | None = None,
                     distinct: int | None = None, distinct_limit: int = DISTINCT_LIMIT,
                     accuracy: int = ACCURACY, checkpoint_slices: bool = True) -> dict[int, float]:
    """Exact values at the given 0-based ranks of column ``v`` of ``values``."""
    if n is None or distinct is None:
        n, distinct = count_and_distinct(values)
    ranks = sorted(set(int(r) for r in ranks))
    if n == 0 or not ranks:
        return {}
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError("rank out of range")
    if distinct <= distinct_limit:
        row = values.agg(*[_disc(r, n).alias(f"r{r}") for r in ranks]).first()
        return {r: float(row[f"r{r}"]) for r in ranks}

    # bracket search: state per rank = (lo, hi, rank within [lo, hi], rows in [lo, hi], exact ok)
    state = {r: (None, None, r, n, False) for r in ranks}
    result: dict[int, float] = {}
    widen = 1.0
    for _ in range(64):
        todo = {r: s for r, s in state.items() if r not in result}
        if not todo:
            break
        small = {r: s for r, s in todo.items() if s[3] <= distinct_limit or s[4]}
        if small:
            aggs = [_disc(k, m, lo, hi).alias(f"r{r}") for r, (lo, hi, k, m, _) in small.items()]
            row = values.agg(*aggs).first()
            result.update({r: float(row[f"r{r}"]) for r in small})
            continue
        # 1) approximate brackets inside each slice (one job for all ranks)
        margin = widen * 2.0 / accuracy
        aggs = []
        for r, (lo, hi, k, m, _) in todo.items():
            p = k / max(m - 1, 1)
            ps = [max(0.0, p - margin), min(1.0, p + margin)]
            src = F.when(_between(lo, hi), F.col("v")) if lo is not None else F.col("v")
            aggs.append(F.percentile_approx(src, ps, accuracy).alias(f"a{r}"))
        arow = values.agg(*aggs).first()
        # 2) exact counts below / inside each bracket, distinct count inside (one job)
        caggs = []
        for r, (lo, hi, k, m, _) in todo.items():
            a_lo, a_hi = arow[f"a{r}"]
            inside = _between(lo, hi)
            bracket = inside & (F.col("v") >= F.lit(a_lo)) & (F.col("v") <= F.lit(a_hi))
            caggs.append(F.count_if(inside & (F.col("v") < F.lit(a_lo))).alias(f"b{r}"))
            caggs.append(F.count_if(bracket).alias(f"i{r}"))
            caggs.append(F.approx_count_distinct(F.when(bracket, F.col("v")), 0.02).alias(f"d{r}"))
        crow = values.agg(*caggs).first()
        narrowed = False
        for r, (lo, hi, k, m, _) in todo.items():
            a_lo, a_hi = (float(x) for x in arow[f"a{r}"])
            below, inside_n, inside_d = int(crow[f"b{r}"]), int(crow[f"i{r}"]), int(crow[f"d{r}"])
            if not (below <= k < below + inside_n):
                widen *= 4  # estimate missed the rank: retry with a wider margin
            elif a_lo == a_hi:
                result[r] = a_lo  # the whole bracket is one value
            elif inside_n < m or inside_d <= distinct_limit:
                state[r] = (a_lo, a_hi, k - below, inside_n, inside_d <= distinct_limit)
                narrowed = narrowed or lo is None
            elif accuracy < MAX_ACCURACY:
                accuracy = min(MAX_ACCURACY, accuracy * 8)  # heavy ties: a finer sketch
            else:
                result[r] = by_counts(values.filter(_between(lo, hi)), k)
        if narrowed and checkpoint_slices:
            # Later rounds only need the values inside the brackets (about
            # 4n/accuracy of them): write that slice to the shared checkpoint
            # folder once instead of rescanning the whole column every round.
            open_ = [s_ for r_, s_ in state.items() if r_ not in result]
            if open_ and all(s_[0] is not None for s_ in open_):  # a rank without a bracket still needs all rows
                inside_any = None
                for lo_, hi_, *_ in open_:
                    t_ = _between(lo_, hi_)
                    inside_any = t_ if inside_any is None else inside_any | t_
                ensure_checkpoint_dir(values.sparkSession)
                values = values.filter(inside_any).checkpoint(eager=True)
    for r in ranks:
        if r not in result:
            lo, hi, k, _, _ = state[r]
            result[r] = by_counts(values.filter(_between(lo, hi)), k)
    return result


def by_counts(values: DataFrame, rank: int) -> float:
    """The value at ``rank``, whatever the ties and however many distinct values: a row per partition reaches the driver, and one task
    sorts the distinct values of one partition."""
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    placed = stage(counts.repartitionByRange("v").withColumn("cell", F.spark_partition_id()), "value-counts")
    before = 0
    for cell in sorted(placed.groupBy("cell").agg(F.sum("c").alias("c")).collect(), key=lambda r: r["cell"]):
        if rank < before + cell["c"]:
            upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            mine = placed.where(F.col("cell") == cell["cell"]).select("v", upto.alias("upto"))
            return float(mine.where(F.col("upto") > rank - before).agg(F.min("v")).first()[0])
        before += cell["c"]
    raise ValueError("rank out of range")


def _between(lo, hi) -> Column:
    if lo is None:
        return F.lit(True)
    return (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))


def quantiles_cont(values: DataFrame, probs: list[float], counted: tuple[int, int] | None = None, **kw) -> tuple[list[float], int]:
    """Interpolated quantiles (``percentile_cont``), exact, plus n. ``counted``: values and distinct values (about), should they be known."""
    n, d = counted or count_and_distinct(values)
    if n == 0:
        return [None] * len(probs), 0
    need = []
    for p in probs:
        pos = p * (n - 1)
        need += [math.floor(pos), math.ceil(pos)]
    vals = order_statistics(values, need, n=n, distinct=d, **kw)
    out = []
    for p in probs:
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        if lo == hi:
            out.append(vals[lo])
        else:
            out.append((hi - pos) * vals[lo] + (pos - lo) * vals[hi])
    return out, n


def quantiles_rank(values: DataFrame, probs: list[float], **kw) -> tuple[list[float], int]:
    """Element at 0-based index floor(p * n) of the sorted values, plus n."""
    n, d = count_and_distinct(values)
    if n == 0:
        return [None] * len(probs), 0
    idx = [min(n - 1, int(math.floor(p * n))) for p in probs]
    vals = order_statistics(values, idx, n=n, distinct=d, **kw)
    return [vals[i] for i in idx], n


def quantiles_approx(values: DataFrame, probs: list[float], accuracy: int = 10_000) -> tuple[list[float], int]:
    """One pass, ``percentile_approx`` (rank error at most n / accuracy)."""
    row = values.agg(F.percentile_approx("v", list(probs), accuracy).alias("q"),
                     F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return [None] * len(probs), 0
    return [float(x) for x in row["q"]], int(row["n"])
