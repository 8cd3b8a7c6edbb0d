"""Profiles that merge: a table of per-day sketches, so that a new day does not read the old ones again.

A day's profile has a row per column with exact counts, extremes and moments, an HLL sketch of its distinct values and a KLL sketch of its
quantiles. Any days are merged at query time by aggregates over those small rows; the sketches take a few kilobytes whatever the day holds.

Bounds: the distinct estimate is within about 3 x 1.04 / sqrt(2 ** lg_k) of the truth (5 % with 12), a quantile's rank within about 1 % of the
rows with k = 400.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K, KLL_K = 12, 400
DISTINCT_BOUND, RANK_BOUND = 0.05, 0.01


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def day_profiles(df: DataFrame, ts_column: str, columns: list[str], lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """A row per day and column, from one scan: day, column_name, n_rows, n_nulls, and, of numeric columns, lowest, highest, total, squares; then
    distinct_sketch and quantile_sketch (null where there are no values). NaN counts as null. Rows without a time are the null day."""
    if not columns:
        raise ValueError("a profile needs columns")
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_rows")]
    for i, c in enumerate(columns):
        numeric = _numeric(df.schema[c].dataType)
        x = F.col(c).cast("double") if numeric else F.col(c).cast("string")
        there = x.isNotNull() & ~F.isnan(x) if numeric else x.isNotNull()
        value = F.when(there, x)
        none = F.lit(None).cast("double")
        kll = F.kll_sketch_agg_double(value, kll_k) if numeric else F.lit(None).cast("binary")
        facts = F.struct(F.lit(c).alias("column_name"), F.count_if(~there).cast("bigint").alias("n_nulls"),
                         *[(f(value) if numeric else none).alias(n) for n, f in (("lowest", F.min), ("highest", F.max), ("total", F.sum))],
                         (F.sum(value * value) if numeric else none).alias("squares"),
                         F.hll_sketch_agg(F.when(there, F.xxhash64(x)), lg_k).alias("distinct_sketch"),
                         F.when(F.count(value) > 0, kll).alias("quantile_sketch"))
        aggs.append(facts.alias(f"__p{i}"))
    days = df.groupBy(F.to_date(F.col(ts_column)).alias("day")).agg(*aggs)
    return days.select("day", "n_rows", F.explode(F.array(*[f"__p{i}" for i in range(len(columns))])).alias("p")).select("day", "n_rows", "p.*").select(
        "day", "column_name", "n_rows", "n_nulls", "lowest", "highest", "total", "squares", "distinct_sketch", "quantile_sketch")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Store the days of ``profiles``; days that are there already are replaced, others left alone."""
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_profile(profiles: DataFrame, probs: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row per column over all days given: column_name, n_rows, n_nulls, lowest, highest, mean, std_dev (sample), distinct_estimate, and ``quantiles``
    (at ``probs``; null for columns that are not numeric). ``where`` on day picks the days."""
    n = F.col("n_rows") - F.col("n_nulls")
    merged = profiles.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sum(F.when(F.col("total").isNotNull(), n)).alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("quantile_sketch").alias("sketch"), F.count("quantile_sketch").alias("sketches"))
    mean = F.col("total") / F.col("n")
    spread = F.greatest((F.col("squares") - F.col("total") * mean) / (F.col("n") - 1), F.lit(0.0))
    at = F.array(*[F.lit(float(p)) for p in probs])
    return merged.select("column_name", "n_rows", "n_nulls", "lowest", "highest", F.when(F.col("n") > 0, mean).alias("mean"),
                         F.when(F.col("n") > 1, F.sqrt(spread)).alias("std_dev"), "distinct_estimate",
                         F.when(F.col("sketches") > 0, F.kll_sketch_get_quantile_double("sketch", at)).alias("quantiles"))
