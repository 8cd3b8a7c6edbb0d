"""Small helpers the operators share: written intermediates, hot-key joins and file access in tasks."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

import sieve
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sieve.staging import release_staged, scratch_path, stage

__all__ = ["as_uri", "attempt_name", "buckets_for", "forget_kept", "join_staged", "kept_in_worker", "lean", "open_input", "open_output", "release_memory", "release_staged", "scratch_path", "ship_package", "stage"]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library where their path does not have it already (a session started from another folder)."""
    root = Path(sieve.__file__).resolve().parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or getattr(context, "_sieve_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.glob("sieve/**/*.py")):
            z.write(f, f.relative_to(root))
    path = f"{scratch_path(spark, 'package')}/sieve.zip"
    with open_output(as_uri(path)) as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    context._sieve_shipped = True


_KEPT: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """What ``make`` returns, made once for a key in each Python worker and kept between its tasks. A worker keeps one such
    thing at a time, so the caches of one operator do not stand beside those of the next."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """Let go of what an earlier operator's tasks kept in this worker."""
    _KEPT.clear()


def release_memory() -> None:
    """Give what this worker has freed back to the system, so that it does not stand beside the JVM's later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(task: Callable) -> Callable:
    """A task function for ``mapInArrow`` that releases memory when it ends."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def join_staged(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a staged table that has one row per key.

    The planner broadcasts ``groups`` only when its files are below the session's
    broadcast threshold. Otherwise both sides are exchanged for the join alone, so
    AQE splits the partition of a key that holds a large share of ``rows`` and reads
    the one matching group row several times."""
    return rows.join(groups, on, how)


def open_output(uri: str):
    """A file to write, in whatever store the shared folder's URI names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_input(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def as_uri(path: str) -> str:
    """pyarrow takes URIs and absolute paths; Hadoop writes local ones as ``file:/x``."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt of this task uses: a reader goes by the manifest, which lists only the
    files of attempts that finished."""
    ctx = TaskContext.get()
    return f"{prefix}-{ctx.partitionId():06d}-{ctx.taskAttemptId()}{suffix}"


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 256) -> int:
    """How many order-preserving buckets a distributed ranking needs so that each sorts a bounded number of rows."""
    return max(least, -(-rows // per_bucket))
