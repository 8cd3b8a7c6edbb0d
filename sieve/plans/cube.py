"""Quality cube: what rules found, by rule, table, day and further dimensions, with all subtotals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("table_name", "rule_name", "day")


@dataclass
class CubePart:
    """A table, its rules (name -> predicate that a violating row meets), its time column and further dimensions (name -> Column)."""

    table_name: str
    df: DataFrame
    rules: dict[str, Column]
    ts_column: str | None = None
    dimensions: dict[str, Column] = field(default_factory=dict)


def rule_counts(part: CubePart, extra: list[str]) -> DataFrame:
    """A row per rule, day and further dimensions: ``rows_checked`` and ``violations``. One scan counts all rules of the table: a count for
    each in one partial aggregate, which is small before it is turned to rows."""
    day = F.to_date(F.col(part.ts_column)) if part.ts_column else F.lit(None).cast("date")
    dims = [day.alias("day"), *[part.dimensions.get(n, F.lit(None)).cast("string").alias(n) for n in extra]]
    names = list(part.rules)
    counts = [F.count_if(p).cast("bigint").alias(f"__v{i}") for i, p in enumerate(part.rules.values())]
    grouped = part.df.groupBy(*dims).agg(F.count(F.lit(1)).cast("bigint").alias("rows_checked"), *counts)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule_name"), F.col(f"__v{i}").alias("violations")) for i, n in enumerate(names)]))
    return grouped.select(F.lit(part.table_name).alias("table_name"), "day", *extra, "rows_checked", each.alias("v")).select(
        "table_name", "v.rule_name", "day", *extra, "rows_checked", "v.violations")


def quality_cube(parts: list[CubePart], sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """``rows_checked`` (once for each rule), ``violations`` and ``violation_rate`` (percent, DECIMAL(7,4)) for every combination of table, rule, day and
    the parts' further dimensions, with subtotals.

    ``sets``: the groupings wanted, by default all (the cube). ``grouping_id`` has a bit for each dimension, the first one highest, set where a
    row totals over it; so a null dimension is told from a total. The grouping sets expand counts, not rows."""
    extra = sorted({n for p in parts for n in p.dimensions})
    if clash := {*extra} & {*DIMENSIONS, "rows_checked", "violations", "violation_rate", "grouping_id"}:
        raise ValueError(f"dimension names in use: {', '.join(sorted(clash))}")
    dims = [*DIMENSIONS, *extra]
    if sets is None:
        sets = [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]
    if unknown := {d for s in sets for d in s} - {*dims}:
        raise ValueError(f"no dimension {', '.join(sorted(unknown))}")
    base = reduce(DataFrame.unionByName, [rule_counts(p, extra) for p in parts])
    total, bad = F.sum("rows_checked").cast("bigint"), F.sum("violations").cast("bigint")
    rate = F.when(total > 0, bad.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)")).cast("decimal(7,4)")
    grouped = base.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims])
    return grouped.agg(F.grouping_id().cast("bigint").alias("grouping_id"), total.alias("rows_checked"), bad.alias("violations"), rate.alias("violation_rate"))
