"""Joining rows back to per-key groups when one key may hold a third of the rows.

The groups side (one row per key) comes out of an aggregate. Joined as it is, it
would lend the join its own partitioning, and AQE could not split a hot key of the
rows. So the groups are written once to the shared folder and read back: computed
once however many jobs use them, and a plain exchange (or, where their files are below
the session's broadcast threshold, a broadcast) in the join. AQE then splits the
partition of any hot key of the rows - one that has a group or one that has none -
and reads its one group row several times.

Where most rows have no group, shuffling them only to drop them is the cost of the join. For ``inner`` and ``left_semi`` a Bloom
filter of the groups' keys (``operators.bloom``) drops them first, where the groups are too many for a broadcast and few enough for a filter.

Rows with a NULL key cannot match under ``=``. They are spread over the partitions by a
salt that no group carries, instead of meeting in one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.operators.bloom import CAPACITY, key_filter
from sieve.staging import stage

#: Broadcast hints are given for sides measured to be at most this large.
BROADCAST_BYTES = 64 << 20
SALTS = 1024
#: From so many groups on, rows are filtered before they are shuffled; tables of fewer groups are mostly small enough to be broadcast.
FILTER_FROM = 500_000


def key_bytes(df: DataFrame, columns: list[str]) -> Column:
    """About the bytes a row's key takes: its strings, and 16 for each column."""
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.select(*columns).dtypes if kind in ("string", "binary")]
    return reduce(lambda a, b: a + b, texts, F.lit(16 * len(columns)))


def _match(rows: DataFrame, groups: DataFrame, on: list[tuple[str, str]], null_safe: bool) -> Column:
    pairs = [(rows[a], groups[f"__gk{i}"]) for i, (a, _) in enumerate(on)]
    return reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def join_groups(rows: DataFrame, groups: DataFrame, on: list[tuple[str, str]], how: str = "inner", *,
                null_safe: bool = False, written: bool = False, shuffle: bool = False, prefilter: bool | None = None) -> DataFrame:
    """``rows`` joined (``inner``, ``left``, ``left_semi`` or ``left_anti``) with ``groups`` on ``on`` pairs
    (row column, group column); ``groups`` has one row per key, so rows are never multiplied.

    The result has the row columns plus, for ``inner`` and ``left``, the non-key group columns, whose names must not be
    row columns. ``written``: the groups are a stored table already. ``shuffle``: no broadcast, whatever their size.
    ``prefilter``: whether rows that surely have no group are dropped before the shuffle (``inner`` and ``left_semi``, keys of equal types);
    by default where there are from ``FILTER_FROM`` groups to as many as a filter serves."""
    g = groups if written else stage(groups, "groups")
    payload = [c for c in g.columns if c not in {b for _, b in on}] if how in ("inner", "left") else []
    out = [*rows.columns, *payload]
    if how in ("inner", "left_semi") and prefilter is not False:
        n = g.count()  # a stored table: from its footers
        bloom = key_filter(g, [b for _, b in on], n) if prefilter or FILTER_FROM <= n <= CAPACITY else None
        if bloom is not None and bloom.fits(rows, [a for a, _ in on]):
            rows = bloom.keep(rows, [a for a, _ in on])
            how = "inner"  # the same rows, one group a key; the planner would move a semi join below the filter
    g = g.select(*[F.col(b).alias(f"__gk{i}") for i, (_, b) in enumerate(on)], *payload)
    if shuffle:
        g = g.hint("merge")
    if null_safe or how in ("inner", "left_semi"):  # Spark drops NULL keys of these before it shuffles
        return rows.join(g, _match(rows, g, on, null_safe), how).select(*out)
    unset = reduce(or_, [F.col(a).isNull() for a, _ in on])
    salted = rows.withColumn("__salt", F.when(unset, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1).otherwise(F.lit(0)))
    g = g.withColumn("__gsalt", F.lit(0).cast("long"))
    return salted.join(g, _match(salted, g, on, False) & (salted["__salt"] == g["__gsalt"]), how).select(*out)
