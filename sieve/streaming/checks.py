"""The same checks over data as it arrives (T1-T4), on Structured Streaming.

* T1 ``tag_rows`` / ``run_row_checks``: every row gets ``failed_rules`` (names
  of the row predicates it fails); ``foreachBatch`` splits good and bad rows
  into two datasets.
* T2 ``windowed_trend``: G6 per event-time window with a watermark.
* T3 ``stream_orphans``: stream-static ``left_anti`` against a parent table;
  ``late_parent_orphans``: stream-stream, for parents that arrive after their children.
* T4 ``batch_duplicates`` (D1 per micro-batch), ``run_excess`` (D1 over all
  batches: rows in - distinct keys, with a horizon that bounds what is kept) and
  ``drop_repeats`` (repeats within the watermark removed).

Streams here read a file source; on a cluster the same code takes Kafka or
any other streaming source. Checkpoints and outputs go under the shared
``spark.checkpoint.dir`` so a restarted query resumes exactly once.
"""

from __future__ import annotations

import contextlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.plans.fused import tag_rows
from sieve.staging import scratch_path


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, file_glob: str | None = None,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame over files arriving in ``directory``."""
    r = spark.readStream.format(fmt).schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(directory)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP (with zone); TIMESTAMP_NTZ columns are cast."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def _write_batch(df: DataFrame, path: str) -> None:
    """foreachBatch is at-least-once: each batch owns its ``batch_id`` partition
    and a retried batch overwrites it instead of appending a second copy."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id").parquet(path))


def _new_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}")


def run_row_checks(spark: SparkSession, stream: DataFrame, predicates: dict[str, Column],
                   out_dir: str | None = None, checkpoint: str | None = None,
                   available_now: bool = True, processing_time: str | None = None):
    """Run the predicates over a stream; write ``good`` and ``bad`` datasets.

    Returns (query, good_path, bad_path). With ``available_now`` the query
    processes what is there and stops (batch-like runs on a schedule).
    """
    out_dir = out_dir or _new_dir(spark, "row_checks")
    checkpoint = checkpoint or f"{out_dir}/_checkpoint"
    good, bad = f"{out_dir}/good", f"{out_dir}/bad"
    tagged = tag_rows(stream, predicates)

    def split(batch: DataFrame, batch_id: int) -> None:
        # both writes read the same tagged batch: keep it instead of reading the source twice
        b = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _write_batch(b.filter(F.size("failed_rules") > 0), bad)
            _write_batch(b.filter(F.size("failed_rules") == 0).drop("failed_rules"), good)
        finally:
            b.unpersist()

    w = tagged.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start(), good, bad


def windowed_trend(stream: DataFrame, ts_column: str, counts: dict[str, Column], window: str = "1 day",
                   watermark: str = "1 day") -> DataFrame:
    """Per event-time window: rows and one count per condition. Rows later
    than the watermark are dropped; in append mode a window is emitted once
    the watermark passes its end."""
    s = event_time(stream, ts_column).withWatermark(ts_column, watermark)
    aggs = [F.count(F.lit(1)).cast("bigint").alias("records_checked")]
    aggs += [F.count_if(c).cast("bigint").alias(n) for n, c in counts.items()]
    return s.groupBy(F.window(ts_column, window).alias("window")).agg(*aggs)


def stream_orphans(stream: DataFrame, column: str, parent: DataFrame, parent_column: str,
                   allow_null: bool = True) -> DataFrame:
    """Stream rows whose key has no row in the static parent (stream-static anti join)."""
    src = stream.filter(F.col(column).isNotNull()) if allow_null else stream
    keys = parent.select(F.col(parent_column).alias("__ref_key")).where(F.col("__ref_key").isNotNull())
    return src.join(keys, src[column] == keys["__ref_key"], "left_anti")


def batch_duplicates(batch: DataFrame, keys: list[str], batch_id: int) -> DataFrame:
    """T4 (per micro-batch): D1 figures of one batch, tagged with its id."""
    from sieve.operators.duplicates import duplicates

    return duplicates(batch, keys).summary.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "*")


def run_batch_duplicates(spark: SparkSession, stream: DataFrame, keys: list[str], out_dir: str | None = None,
                         checkpoint: str | None = None):
    """T4: D1 per micro-batch, one summary row per batch appended to ``out_dir``."""
    out_dir = out_dir or _new_dir(spark, "batch_duplicates")
    checkpoint = checkpoint or f"{out_dir}/_checkpoint"
    path = f"{out_dir}/summary"

    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch_duplicates(batch, keys, batch_id), path)

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return q, path


def late_parent_orphans(child: DataFrame, column: str, child_ts: str, parent: DataFrame, parent_column: str, parent_ts: str,
                        before: str = "1 day", after: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """T3 (both sides streams): child rows with no parent row of their key from ``before`` ahead of them until ``after`` they came, by event time.

    An outer join with watermarks on both sides: a child is kept as state until the parents' watermark says that none can come any more, and
    is emitted once if none did; a parent that is late, but within ``after``, clears it. State on either side expires with the
    watermarks, so it is bounded by the time span. Rows later than ``watermark`` are dropped, children without a key are no orphans."""
    c = event_time(child.filter(F.col(column).isNotNull()), child_ts).withWatermark(child_ts, watermark)
    p = event_time(parent.filter(F.col(parent_column).isNotNull()), parent_ts)
    p = p.select(F.col(parent_column).alias("__pk"), F.col(parent_ts).alias("__pt")).withWatermark("__pt", watermark)
    near = (F.col("__pt") >= F.col(child_ts) - F.expr(f"INTERVAL {before}")) & (F.col("__pt") <= F.col(child_ts) + F.expr(f"INTERVAL {after}"))
    return c.join(p, (c[column] == p["__pk"]) & near, "left_outer").where(F.col("__pk").isNull()).drop("__pk", "__pt")


_TOTALS = "version bigint, rows bigint, keys bigint, newest timestamp"


def _version(path: str, version: int) -> tuple[str, str]:
    return f"{path}/v={version}/keys", f"{path}/v={version}/totals"


def _stored(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    store, target = _stored(spark, path)
    store.delete(target, True)


def run_excess(spark: SparkSession, stream: DataFrame, keys: list[str], out_dir: str | None = None,
               checkpoint: str | None = None, ts_column: str | None = None, horizon: str | None = None):
    """T4 (across batches): excess rows over all batches, from a compacted table of rows per key. Returns (query, path); ``excess_summary``
    reads it.

    Each batch replaces the table by a new version: its own counts are added, and keys whose last row is more than ``horizon`` older (by
    ``ts_column``) than the newest row so far are closed, that is, added to the totals and dropped. So the table holds the keys of one
    horizon at most, a key that comes again later begins anew, and nothing has to be read but the last version. Without a horizon every key is kept.

    A batch that is run again after a failure reads the version before its own and overwrites its own; older versions are removed.
    Rows without a time do not hold a key open."""
    if (ts_column is None) != (horizon is None):
        raise ValueError("a horizon needs ts_column, and ts_column a horizon")
    out_dir = out_dir or _new_dir(spark, "excess")
    checkpoint = checkpoint or f"{out_dir}/_checkpoint"
    path = f"{out_dir}/counts"
    seen = F.col(ts_column).cast("timestamp") if ts_column else F.lit(None).cast("timestamp")
    empty_keys, empty_totals = _version(path, -1)
    nothing = spark.createDataFrame([], stream.select(*keys).schema)
    nothing = nothing.withColumns({"__rows": F.lit(0).cast("bigint"), "__last": F.lit(None).cast("timestamp")})
    store, target = _stored(spark, path)
    if not store.exists(target):  # the start; a restarted stream finds its last version
        nothing.write.parquet(empty_keys)
        spark.createDataFrame([(-1, 0, 0, None)], _TOTALS).write.parquet(empty_totals)

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old_keys, old_totals = _version(path, batch_id - 1)
        new_keys, new_totals = _version(path, batch_id)
        old = session.read.schema(nothing.schema).parquet(old_keys)
        fresh = batch.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("__rows"), F.max(seen).alias("__last"))
        merged = old.unionByName(fresh).groupBy(*keys).agg(F.sum("__rows").alias("__rows"), F.max("__last").alias("__last"))
        merged = merged.persist(StorageLevel.MEMORY_AND_DISK)  # read twice; recomputed from files if lost
        try:
            before = session.read.schema(_TOTALS).parquet(old_totals).first()
            newest = max((x for x in (before["newest"], merged.agg(F.max("__last")).first()[0]) if x is not None), default=None)
            open_ = F.lit(True) if horizon is None else F.coalesce(F.col("__last") >= F.lit(newest) - F.expr(f"INTERVAL {horizon}"), F.lit(False))
            closed = merged.where(~open_).agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("k")).first()
            merged.where(open_).write.mode("overwrite").parquet(new_keys)
        finally:
            merged.unpersist()
        row = (batch_id, before["rows"] + closed["r"], before["keys"] + closed["k"], newest)
        session.createDataFrame([row], _TOTALS).coalesce(1).write.mode("overwrite").parquet(new_totals)  # last: the version counts from here on
        _delete(session, f"{path}/v={batch_id - 2}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return q, path


def excess_summary(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """rows_in, rows_out (keys, counted again after a horizon without them) and violation_count = rows in - rows out, over all batches so far."""
    totals = max(spark.read.schema(_TOTALS).parquet(f"{path}/*/totals").collect(), key=lambda r: r["version"])  # two versions at most
    live = spark.read.parquet(_version(path, totals["version"])[0])
    rows = (F.coalesce(F.sum("__rows"), F.lit(0)) + totals["rows"]).cast("bigint")
    groups = (F.count(F.lit(1)) + totals["keys"]).cast("bigint")
    return live.agg(rows.alias("rows_in"), groups.alias("rows_out"), (rows - groups).alias("violation_count"))


def open_keys(spark: SparkSession, path: str) -> int:
    """How many keys the last version keeps."""
    totals = max(spark.read.schema(_TOTALS).parquet(f"{path}/*/totals").collect(), key=lambda r: r["version"])
    return spark.read.parquet(_version(path, totals["version"])[0]).count()


def drop_repeats(stream: DataFrame, keys: list[str], ts_column: str, watermark: str = "1 hour") -> DataFrame:
    """T4 (across batches): drop rows repeating a key seen within the watermark.
    State per key expires with the watermark, so it stays bounded."""
    s = event_time(stream, ts_column).withWatermark(ts_column, watermark)
    return s.dropDuplicatesWithinWatermark(keys)


@contextlib.contextmanager
def state_partitions(spark: SparkSession, n: int):
    """Streams that are first started inside keep their state in ``n`` partitions (it is fixed with their checkpoint); a stream whose state is
    small pays for each of them in every batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_parquet(spark: SparkSession, df: DataFrame, name: str, output_mode: str = "append",
                   out_dir: str | None = None) -> tuple[object, str]:
    """Run a streaming DataFrame to completion on what is available; write Parquet.

    Complete mode (aggregations) rewrites the full result each batch through
    ``foreachBatch``; append mode uses the exactly-once file sink.
    """
    out_dir = out_dir or _new_dir(spark, name)
    path, ck = f"{out_dir}/data", f"{out_dir}/_checkpoint"
    if output_mode == "complete":
        def each(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        q = (df.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
    else:
        q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
    return q, path
