"""Statistics of many columns in one pass over a table, for all its outlier rules together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators import quantiles as Q

QUARTILES = [0.25, 0.5, 0.75]


def column_statistics(df: DataFrame, moments: list[str], quartiles: list[str], exact_values: int = Q.DISTINCT_LIMIT) -> dict[str, dict]:
    """Per column: n (values that are neither NULL nor NaN), mean and std (of ``moments`` columns), q (of ``quartiles``: interpolated q1, median, q3).

    One aggregate takes the moments of all columns and, where the table has at most ``exact_values`` rows over all quartile columns (counted
    first, which for Parquet reads footers alone), their exact quartiles too. In a larger table the same pass takes what the bracket
    search of ``operators.quantiles`` starts from."""
    moments, quartiles = list(dict.fromkeys(moments)), list(dict.fromkeys(quartiles))
    columns = list(dict.fromkeys([*moments, *quartiles]))
    if not columns:
        return {}
    small = bool(quartiles) and df.count() * len(quartiles) <= exact_values
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        x = F.when(x.isNotNull() & ~F.isnan(x), x)
        aggs.append(F.count(x).alias(f"n{i}"))
        if c in moments:
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        if c in quartiles:
            aggs.append((F.percentile(x, QUARTILES) if small else F.approx_count_distinct(x, 0.02)).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    found = {}
    for i, c in enumerate(columns):
        found[c] = one = {"n": int(row[f"n{i}"])}
        if c in moments:
            one |= {"mean": row[f"m{i}"], "std": row[f"s{i}"]}
        if c in quartiles:
            if not one["n"]:
                one["q"] = (None, None, None)
            elif small:
                one["q"] = tuple(float(v) for v in row[f"q{i}"])
            else:
                one["q"] = tuple(Q.quantiles_cont(Q.clean_values(df, c), QUARTILES, counted=(one["n"], int(row[f"q{i}"] or 0)))[0])
    return found
