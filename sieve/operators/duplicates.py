"""Duplicate checks.

Groups come from one ``groupBy`` (partial aggregation on the map side, so a hot key
costs one row per map task, not a third of the table in one task) over keys of bounded
width: a long text stands in a key by its beginning and its SHA-256. Member rows are
found by joining the rows back to the duplicated groups (``operators.skew``), never by a
window, which would sort a hot group inside a single task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.predicates import is_string
from sieve.operators.base import Outcome
from sieve.operators.skew import join_groups

#: Strings of this length or longer are represented in keys by a string of this very length.
LONG = 128
MAX_LONG = 2**63 - 1


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_key(c: Column) -> Column:
    """A string as it is if shorter than ``LONG``, else its first characters and its SHA-256 (64 hex digits)."""
    return F.when(F.length(c) < LONG, c).otherwise(F.concat(F.substring(c, 1, LONG - 64), F.sha2(c.cast("binary"), 256)))


def _keys(df: DataFrame, columns: list[str], case_sensitive: bool) -> list[Column]:
    out = []
    for c in columns:
        expr = F.col(c)
        if is_string(df, c):
            expr = short_key(expr if case_sensitive else F.lower(expr))
        out.append(expr)
    return out


def _source(df: DataFrame, columns: list[str], ignore_null: bool) -> DataFrame:
    return df.dropna(subset=list(columns)) if ignore_null else df


def _names(columns: list[str], letter: str = "k") -> list[str]:
    return [f"__{letter}{i}" for i in range(len(columns))]


def _groups_keyed(df: DataFrame, columns: list[str], case_sensitive: bool, ignore_null: bool) -> DataFrame:
    """Duplicated groups: keys ``__k*`` of bounded width and ``duplicate_count`` (a hash aggregate)."""
    keys = _keys(df, columns, case_sensitive)
    g = _source(df, columns, ignore_null).groupBy(*[e.alias(k) for k, e in zip(_names(columns), keys, strict=True)])
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("duplicate_count")).filter(F.col("duplicate_count") > 1)


def duplicate_groups(df: DataFrame, columns: list[str], case_sensitive: bool = True,
                     ignore_null: bool = True) -> DataFrame:
    """Every duplicated group with its ``duplicate_count``.

    Case-insensitive groups show the smallest spelling; they are counted by spelling first, so
    that only spellings meet in the second aggregate."""
    counted = _source(df, columns, ignore_null).groupBy(*columns).agg(F.count(F.lit(1)).cast("bigint").alias("duplicate_count"))
    if not case_sensitive and any(is_string(df, c) for c in columns):
        keys = [(F.lower(F.col(c)) if is_string(df, c) else F.col(c)).alias(k) for k, c in zip(_names(columns), columns, strict=True)]
        counted = counted.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns], F.sum("duplicate_count").alias("duplicate_count"))
    return counted.filter(F.col("duplicate_count") > 1).select(*columns, "duplicate_count")


def top_duplicate_groups(df: DataFrame, columns: list[str], n: int = 10, **opts) -> DataFrame:
    """D2 report: the ``n`` largest groups (count desc, keys asc as tie-break)."""
    g = duplicate_groups(df, columns, **opts)
    return g.orderBy(F.col("duplicate_count").desc(), *[F.col(c).asc_nulls_first() for c in columns]).limit(n)


def _keyed_rows(df: DataFrame, columns: list[str], case_sensitive: bool, ignore_null: bool) -> DataFrame:
    src = _source(df, columns, ignore_null)
    return src.select("*", *[e.alias(r) for r, e in zip(_names(columns, "r"), _keys(df, columns, case_sensitive), strict=True)])


def duplicate_members(df: DataFrame, columns: list[str], case_sensitive: bool = True,
                      ignore_null: bool = True, shuffle: bool = False, prefilter: bool | None = None) -> DataFrame:
    """D3: every row of every duplicated group, with ``group_size`` (an underscore is added if the table has such a column).

    A join back to the duplicated groups, which are computed once and written (see ``operators.skew``); rows that are surely in none
    need not be shuffled (``prefilter``)."""
    size = free_name(df, "group_size")
    g = _groups_keyed(df, columns, case_sensitive, ignore_null).withColumnRenamed("duplicate_count", size)
    keyed = _keyed_rows(df, columns, case_sensitive, ignore_null)
    on = list(zip(_names(columns, "r"), _names(columns), strict=True))
    return join_groups(keyed, g, on, "inner", null_safe=not ignore_null, shuffle=shuffle,
                       prefilter=prefilter).select(*df.columns, size)


def _with_top(df: DataFrame, tops: DataFrame, columns: list[str], case_sensitive: bool, ignore_null: bool) -> DataFrame:
    """Rows of a few groups (a bounded number, so they are broadcast): one scan, no shuffle."""
    keyed = _keyed_rows(df, columns, case_sensitive, ignore_null)
    pairs = [(keyed[r], tops[k]) for r, k in zip(_names(columns, "r"), _names(columns), strict=True)]
    return keyed.join(F.broadcast(tops), reduce(and_, [a == b if ignore_null else a.eqNullSafe(b) for a, b in pairs]))


def member_sample(df: DataFrame, columns: list[str], n: int, case_sensitive: bool = True, ignore_null: bool = True,
                  groups: DataFrame | None = None) -> DataFrame:
    """D3 report: the first ``n`` of all member rows, ordered by the key columns and then by all others.

    They lie in the ``n`` groups with the smallest keys, so only those groups' rows are sorted."""
    size = free_name(df, "group_size")
    g = groups if groups is not None else _groups_keyed(df, columns, case_sensitive, ignore_null)
    first = g.orderBy(*[F.col(k).asc_nulls_first() for k in _names(columns)]).limit(n).withColumnRenamed("duplicate_count", size)
    rows = _with_top(df, first, columns, case_sensitive, ignore_null).select(*df.columns, size)
    rest = [c for c in df.columns if c not in columns]
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in [*columns, *rest]]).limit(n)


def duplicates(df: DataFrame, columns: list[str], case_sensitive: bool = True,
               ignore_null: bool = True) -> Outcome:
    """D1 + D4 + D5 (D6 ``uniqueness`` is the same with one column).

    ``violation_count`` counts excess rows: sum(count - 1) over groups with
    count > 1. The summary also gives ``group_count`` (true number of groups)
    and ``member_rows``.
    """
    if not columns:
        raise ValueError("duplicates check needs 'columns'")
    for c in columns:
        df.schema[c]
    g = _groups_keyed(df, columns, case_sensitive, ignore_null)

    def summary() -> DataFrame:
        return g.agg(
            F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).cast("bigint").alias("violation_count"),
            F.count(F.lit(1)).cast("bigint").alias("group_count"),
            F.coalesce(F.sum("duplicate_count"), F.lit(0)).cast("bigint").alias("member_rows"),
        )

    def top(n: int = 10) -> DataFrame:
        """The largest groups with their values; where a key is not the value (long or folded), the smallest of the group's."""
        order = [F.col("duplicate_count").desc(), *[F.col(k).asc_nulls_first() for k in _names(columns)]]
        tops = g.orderBy(*order).limit(n)
        texts = [k for k, c in zip(_names(columns), columns, strict=True) if is_string(df, c)]
        plain = not texts or (case_sensitive and tops.where(reduce(or_, [F.length(k) >= LONG for k in texts])).isEmpty())
        if plain:
            return tops.select(*[F.col(k).alias(c) for k, c in zip(_names(columns), columns, strict=True)], "duplicate_count").orderBy(
                F.col("duplicate_count").desc(), *[F.col(c).asc_nulls_first() for c in columns])
        rows = _with_top(df, tops, columns, case_sensitive, ignore_null)
        values = [F.min(rows[c]).alias(c) for c in columns]
        found = rows.groupBy(*[rows[k] for k in _names(columns)]).agg(*values, F.max(rows["duplicate_count"]).alias("duplicate_count"))
        return found.select(*columns, "duplicate_count").orderBy(F.col("duplicate_count").desc(), *columns)

    return Outcome(
        violations=lambda: duplicate_members(df, columns, case_sensitive, ignore_null),
        summary=summary,
        metadata={"columns_checked": list(columns), "case_sensitive": case_sensitive,
                  "ignore_null": ignore_null},
        extras={"groups": top, "sample": lambda n: member_sample(df, columns, n, case_sensitive, ignore_null, g), "persist": [g]},
        sample_order=[columns[0]],
    )


def fuzzy_duplicates(df: DataFrame, id_column: str, phonetic_columns: list[str],
                     exact_columns: list[str] = ()) -> Outcome:
    """Sound-alike duplicates - same ``soundex`` on the phonetic columns and
    equal exact columns.

    Rows are blocked on those keys with one aggregate. Instead of emitting all
    n(n-1)/2 pairs of a block (quadratic in a hot block), every member is paired
    with its block's anchor (smallest id): ``anchor_id, match_id``. The full
    pair count is still exact: ``violation_count`` = sum n(n-1)/2 over blocks,
    summed as decimals (and given as the largest BIGINT should it exceed that).
    """
    cols = list(phonetic_columns) + list(exact_columns)
    src = df.dropna(subset=cols + [id_column])
    sounds = [F.soundex(F.col(c)).alias(f"__sx_{c}") for c in phonetic_columns]
    equal = [(short_key(F.col(c)) if is_string(df, c) else F.col(c)).alias(f"__eq_{c}") for c in exact_columns]
    names = [f"__sx_{c}" for c in phonetic_columns] + [f"__eq_{c}" for c in exact_columns]
    keyed = src.select(F.col(id_column).alias("match_id"), *sounds, *equal, *[F.col(c).alias(f"__v_{c}") for c in exact_columns])
    blocks = (keyed.groupBy(*names)
                   .agg(F.min("match_id").alias("anchor_id"), F.count(F.lit(1)).cast("bigint").alias("block_size"))
                   .filter(F.col("block_size") > 1))

    def violations() -> DataFrame:
        g = blocks.select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(names)], "anchor_id", "block_size")
        members = join_groups(keyed, g, [(b, f"__b{i}") for i, b in enumerate(names)], "inner")
        shown = ([F.col(f"__sx_{c}").alias(f"soundex_{c}") for c in phonetic_columns]
                 + [F.col(f"__v_{c}").alias(c) for c in exact_columns])
        return members.filter(F.col("match_id") != F.col("anchor_id")).select("anchor_id", "match_id", *shown, "block_size")

    def summary() -> DataFrame:
        n = F.col("block_size").cast("decimal(19,0)")
        return blocks.agg(
            F.sum((n * (n - 1)).cast("decimal(38,0)")).alias("__twice"), F.count(F.lit(1)).cast("bigint").alias("block_count"),
            F.coalesce(F.max("block_size"), F.lit(0)).cast("bigint").alias("largest_block"),
        ).select((F.least(F.coalesce(F.col("__twice"), F.lit(0).cast("decimal(38,0)")), F.lit(str(2 * MAX_LONG)).cast("decimal(38,0)")) / 2).cast("bigint").alias("violation_count"),
                 "block_count", "largest_block")

    return Outcome(violations=violations, summary=summary,
                   metadata={"id_column": id_column, "phonetic_columns": list(phonetic_columns),
                             "exact_columns": list(exact_columns)},
                   sample_order=["anchor_id", "match_id"])
