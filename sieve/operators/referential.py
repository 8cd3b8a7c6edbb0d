"""Referential-integrity checks.

Two plans, chosen when the check first runs and behind a measured size: parent keys that fit a
broadcast are broadcast, and the child is scanned once without a shuffle; others meet the
child's distinct keys (one row per key after partial aggregation), and child rows are joined back to the keys
found (``operators.skew``). Building a check starts no job. Bloom filters (``operators.bloom``) keep out of both shuffles what cannot
matter: parents that no child refers to, where there are many, and child rows that are no orphans.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.base import Outcome, count_summary
from sieve.operators.bloom import CAPACITY, key_filter
from sieve.operators.skew import BROADCAST_BYTES, FILTER_FROM, join_groups, key_bytes
from sieve.staging import stage

_K = "__ref_key"

#: Parent keys beyond this number are not broadcast either, however narrow.
BROADCAST_KEYS_LIMIT = 1_000_000


def _parent_keys(parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-NULL parent keys."""
    return parent.select(F.col(parent_column).alias(_K)).where(F.col(_K).isNotNull())


def parent_fits(parent: DataFrame, parent_column: str, broadcast_limit: int = BROADCAST_KEYS_LIMIT) -> tuple[bool, int]:
    """Whether the parent's keys may be broadcast, and their number: one map-only job counts rows and bytes, which
    bound the distinct keys from above."""
    keys = _parent_keys(parent, parent_column)
    row = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key_bytes(keys, [_K])), F.lit(0)).alias("bytes")).first()
    return row["n"] <= broadcast_limit and row["bytes"] <= BROADCAST_BYTES, int(row["n"])


def referred_parents(per_key: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The child's distinct keys, written once, and of the parents' ``keys`` those that may be among them (all, where there are too many
    child keys for a filter or their types differ)."""
    per_key = stage(per_key, "child-keys")
    bloom = key_filter(per_key, [column], per_key.count())
    return per_key, bloom.keep(keys, [_K]) if bloom is not None and bloom.fits(keys, [_K]) else keys


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str,
                allow_null: bool = True, parent_rows: int = 0, prefilter: bool | None = None) -> DataFrame:
    """Distinct orphan keys with their row counts: ``(<column>, rows)``.

    The child is first reduced to one row per key, then anti-joined with the distinct parent
    keys: the join moves distinct keys, not child rows. Where the parents (``parent_rows``, if known) are at least four times as many as the
    child's distinct keys (estimated by one scan of the column), those that no child refers to are dropped before they are shuffled;
    ``prefilter`` says so outright."""
    src = child.filter(F.col(column).isNotNull()) if allow_null else child
    per_key = src.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    keys = _parent_keys(parent, parent_column)
    if prefilter is None and parent_rows >= FILTER_FROM:
        prefilter = 4 * child.agg(F.approx_count_distinct(column)).first()[0] <= min(parent_rows, 4 * CAPACITY)
    if prefilter:
        per_key, keys = referred_parents(per_key, column, keys)
    return per_key.join(keys.distinct(), per_key[column] == F.col(_K), "left_anti")


def flag_orphans(rows: DataFrame, column: str, parent: DataFrame, parent_column: str, flag: str,
                 broadcast_limit: int = BROADCAST_KEYS_LIMIT) -> DataFrame:
    """``rows`` with boolean ``flag``: the key is set and has no parent (a NULL key is not an orphan)."""
    small, n = parent_fits(parent, parent_column, broadcast_limit)
    if small:
        keys = _parent_keys(parent, parent_column).distinct().withColumn("__there", F.lit(True))
        joined = rows.join(F.broadcast(keys), rows[column] == keys[_K], "left")
        return joined.select(*[rows[c] for c in rows.columns], (rows[column].isNotNull() & F.col("__there").isNull()).alias(flag))
    missing = orphan_keys(rows, column, parent, parent_column, parent_rows=n).select(F.col(column).alias(_K), F.lit(True).alias("__gone"))
    joined = join_groups(rows, missing, [(column, _K)], "left", shuffle=broadcast_limit == 0)
    return joined.withColumn(flag, F.col("__gone").isNotNull()).drop("__gone")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str,
            allow_null: bool = True, broadcast_limit: int = BROADCAST_KEYS_LIMIT, prefilter: bool | None = None) -> Outcome:
    """Child rows whose key has no parent.

    ``allow_null=True`` (default) skips NULL keys; with False a NULL key is a violation too.
    ``broadcast_limit=0`` forces the plan for large parents, ``prefilter`` its Bloom filters (by default used where they pay)."""
    src = child.filter(F.col(column).isNotNull())
    unset = child.filter(F.col(column).isNull())

    @cache
    def fits() -> tuple[bool, int]:
        return parent_fits(parent, parent_column, broadcast_limit)

    @cache
    def keys() -> DataFrame:
        return orphan_keys(child, column, parent, parent_column, allow_null, fits()[1], prefilter)

    def listing() -> DataFrame:
        if fits()[0]:
            pk = _parent_keys(parent, parent_column)
            rows = child if not allow_null else src
            return rows.join(F.broadcast(pk), rows[column] == pk[_K], "left_anti")
        gone = keys().where(F.col(column).isNotNull()).select(F.col(column).alias(_K))
        found = join_groups(src, gone, [(column, _K)], "left_semi", shuffle=broadcast_limit == 0, prefilter=prefilter)
        return found if allow_null else found.unionByName(unset)  # NULL keys need no join

    def summary() -> DataFrame:
        if fits()[0]:
            return count_summary(listing())
        return keys().agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("violation_count"))

    def metadata() -> dict:
        small, n = fits()
        return {"source_column": column, "reference_column": parent_column, "allow_null": allow_null, "parent_key_rows": n,
                "plan": "broadcast parent keys" if small else "pre-aggregated child keys"}

    return Outcome(
        violations=listing,
        summary=summary,
        metadata=metadata,
        extras={"orphan_values": lambda limit=20: orphan_values(listing() if fits()[0] else keys(), column, limit)},
        sample_order=[column],
    )


def orphan_values(keys: DataFrame, column: str, limit: int | None = 20) -> DataFrame:
    """Distinct orphan keys, ascending; the report keeps the first ``limit``."""
    vals = keys.select(F.col(column).alias("orphan_value")).distinct()
    ordered = vals.orderBy(F.col("orphan_value").asc_nulls_first())
    return ordered.limit(limit) if limit else ordered


def orphan_counts(relationships: list[tuple[str, DataFrame, str, DataFrame, str]],
                  allow_null: bool = True) -> DataFrame:
    """``relationship, orphan_count`` for each (label, child, col, parent, parent_col)."""
    parts = [
        orphans(c, col, p, pcol, allow_null).summary
        .select(F.lit(label).alias("relationship"), F.col("violation_count").alias("orphan_count"))
        for label, c, col, p, pcol in relationships
    ]
    return reduce(DataFrame.unionByName, parts)


def multi_parent_orphans(child: DataFrame, links: list[tuple[str, DataFrame, str]],
                         broadcast_limit: int = BROADCAST_KEYS_LIMIT) -> Outcome:
    """Rows where any optional foreign key is set but has no parent.

    Each link is (child_column, parent, parent_column); every link adds a flag to the rows
    (``flag_orphans``), so parents that fit cost one scan in all and rows are never multiplied."""
    def violations() -> DataFrame:
        out = child
        for i, (column, parent, parent_column) in enumerate(links):
            out = flag_orphans(out, column, parent, parent_column, f"__o{i}", broadcast_limit)
        return out.filter(reduce(or_, [F.col(f"__o{i}") for i in range(len(links))])).select(*child.columns)

    return Outcome(violations=violations, summary=lambda: count_summary(violations()),
                   metadata={"links": [(c, pc) for c, _, pc in links]})
