"""What every check returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lazy = DataFrame | Callable[[], DataFrame]


class Outcome:
    """Result of one check, still lazy.

    ``violations``   every violating row (never capped; S9 writes it out).
    ``summary``      one-row DataFrame whose ``violation_count`` column is the
                     rule's count (plus check-specific figures, e.g. group counts).
                     Only this row and a bounded sample ever reach the driver.
    ``predicate``    for row-level checks on a single table: the boolean Column
                     that selects ``violations`` from the source, so a suite can
                     fuse many such checks into one scan.
    ``source``       the DataFrame ``predicate`` applies to.
    ``sample_order`` ordering for the bounded sample.
    ``annotate``     columns ``violations`` adds to the rows the predicate selects.

    ``violations``, ``summary`` and ``metadata`` may be given as zero-argument callables:
    PySpark analyses every DataFrame when it is created, so a suite that only
    needs the fused count never pays for plans it does not run.
    """

    def __init__(self, violations: Lazy, summary: Lazy, metadata: dict | Callable[[], dict] | None = None,
                 predicate: Column | None = None, source: DataFrame | None = None,
                 sample_order: list | None = None, extras: dict | None = None,
                 annotate: dict[str, Column] | None = None):
        self._violations = violations
        self._summary = summary
        self._metadata = metadata or {}
        self.predicate = predicate
        self.source = source
        self.sample_order = list(sample_order or [])
        self.extras = extras or {}
        self.annotate = annotate or {}

    @property
    def metadata(self) -> dict:
        if callable(self._metadata):
            self._metadata = self._metadata()
        return self._metadata

    @property
    def violations(self) -> DataFrame:
        if not isinstance(self._violations, DataFrame):
            self._violations = self._violations()
        return self._violations

    @property
    def summary(self) -> DataFrame:
        if not isinstance(self._summary, DataFrame):
            self._summary = self._summary()
        return self._summary


def count_summary(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """``violation_count`` as BIGINT from one aggregate (partial + final agg)."""
    if predicate is None:
        return df.agg(F.count(F.lit(1)).cast("bigint").alias("violation_count"))
    return df.agg(F.count_if(predicate).cast("bigint").alias("violation_count"))


def row_check(source: DataFrame, predicate: Column, metadata: dict | None = None,
              annotate: dict | None = None, sample_order=None) -> Outcome:
    """A check that is one predicate over one table."""
    def violations() -> DataFrame:
        v = source.filter(predicate)
        for name, expr in (annotate or {}).items():
            v = v.withColumn(name, expr)
        return v

    return Outcome(
        violations=violations,
        summary=lambda: count_summary(source, predicate),
        metadata=metadata or {},
        predicate=predicate,
        source=source,
        sample_order=list(sample_order or []),
        annotate=annotate,
    )
