"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sieve.session import ensure_checkpoint_dir

#: Paths made outside any job, and the list of the job that runs here.
_STAGED: list[str] = []
_JOB: ContextVar[list[str]] = ContextVar("sieve_staged", default=_STAGED)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared ``spark.checkpoint.dir``, removed at the end of the job that makes it or by ``release_staged``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _JOB.get().append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage (a lost executor costs only the reading tasks), keeps a
    table that several branches read from being computed again, and, unlike
    ``checkpoint()``, forgets the partitioning: both sides of a later join are then
    plain exchanges, which AQE can split where one key is hot."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        with contextlib.suppress(Exception):
            n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextlib.contextmanager
def staged_job(spark: SparkSession) -> Iterator[list[str]]:
    """What is staged inside belongs to this job alone and is removed at its end; yields its list of paths.

    Only what runs in the calling thread belongs to the job; results must be stored before it ends."""
    paths: list[str] = []
    token = _JOB.set(paths)
    try:
        yield paths
    finally:
        _JOB.reset(token)
        _remove(spark, paths)


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stage`` what ``make`` returns, and remove all that it staged on the way."""
    path = scratch_path(spark, name)
    with staged_job(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Remove what ``stage`` and ``scratch_path`` made so far in this job (outside any job: all that belongs to none);
    call it once the results that read it are written."""
    return _remove(spark, _JOB.get())
