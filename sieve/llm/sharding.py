"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows of a source are put in a seeded random order and given the fractional rank
(r - 1/2) / n of that order; all rows are then ordered by fractional rank and cut into
equal runs. Any run holds each source in proportion, to within a row per source.

Both rankings are distributed: rows fall into order-preserving buckets (by hash, then by
fractional rank), a small table of bucket counts gives each bucket's offset, and only a
bucket, never a source, is sorted in one task. So a source with a third of all rows is
spread over as many tasks as any other rows.

Cases: a null text counts as no bytes (size 1, checksum 0); null sources form one source
of their own; rows with a null id are ordered by their place in the input; repeated rows
are separate rows; an empty table gives an empty result; other columns of the input pass
through ``interleave`` untouched, but for columns named ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import buckets_for, stage

TWO63 = float(2**63)


def _rank(df: DataFrame, part: list[str], bucket: str, order: list, total: str, out: str) -> DataFrame:
    """Adds ``out`` (1, 2, ...: place in ``order`` within ``part``) and ``total`` (rows of the part).

    ``bucket`` must rise with ``order``; it bounds what one task sorts."""
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("__sh_n"))
    upto = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = counts.select(*part, bucket, F.coalesce(F.sum("__sh_n").over(upto), F.lit(0)).alias("__sh_off"),
                            F.sum("__sh_n").over(whole).alias(total))
    within = Window.partitionBy(*part, bucket).orderBy(*order)
    return (df.join(offsets, [*part, bucket])
            .withColumn(out, F.col("__sh_off") + F.row_number().over(within)).drop("__sh_off", bucket))


def _keyed(df: DataFrame, rows: int, n: int, id_col: str, source_col: str, seed: int, tie_cols: tuple[str, ...], bucket_rows: int) -> DataFrame:
    """``df`` with a random key, its bucket of ``n``, the source without nulls, and the row's place in the input."""
    place = F.monotonically_increasing_id()
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("long"), place), F.col(id_col).isNull(), *tie_cols)
    bucket = F.least(F.floor((F.col("__sh_key").cast("double") + F.lit(TWO63)) / F.lit(2 * TWO63) * n), F.lit(n - 1))
    keyed = df.select("*", key.alias("__sh_key"), place.alias("__sh_row"), F.col(source_col).isNull().alias("__sh_null"),
                      F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__sh_src"))
    # Written before it is read twice: a row keeps its key even if its place in the input is not the same in every run of a scan.
    keyed = stage(keyed.withColumn("__sh_b", bucket), "shard-keys")
    # At most rows / (4 * bucket_rows) of them.
    full = keyed.groupBy("__sh_b").count().where(F.col("count") > 4 * max(bucket_rows, rows // n)).select("__sh_b", F.lit(True).alias("__sh_full"))
    spread = F.when(F.col("__sh_full"), F.xxhash64(F.lit(seed), "__sh_key", "__sh_row")).otherwise(F.col("__sh_key"))
    return keyed.join(F.broadcast(full), "__sh_b", "left").withColumn("__sh_key", spread).withColumn("__sh_b", bucket).drop("__sh_full")


def interleave(df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", shards: int = 16, seed: int = 7,
               tie_cols: tuple[str, ...] = (), bucket_rows: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (0 .. shards-1, row counts at most one apart) and ``slot`` (gapless from 0 in a shard).

    ``tie_cols`` tell rows that share an id apart. A row's place depends on its id, these columns, the seed and the other rows, not on
    file layout; excepted are rows with a null id, and buckets that hold several times their share since rows repeat: there the
    place in the input enters the key, which spreads them."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.count()
    n = buckets_for(rows, bucket_rows)
    keyed = _keyed(df.select(*keep), rows, n, id_col, source_col, seed, tie_cols, bucket_rows)
    ties = [*[F.col(c).asc_nulls_first() for c in (id_col, *tie_cols)], F.col("__sh_row")]
    ranked = _rank(keyed, ["__sh_null", "__sh_src"], "__sh_b", [F.col("__sh_key"), *ties], "__sh_total", "__sh_rank")
    ranked = stage(ranked.withColumn("__sh_frac", (F.col("__sh_rank") - 0.5) / F.col("__sh_total"))
                   .drop("__sh_total", "__sh_key", "__sh_row"), "shard-ranks")
    placed = ranked.select("*", F.lit(0).alias("__sh_all"),
                           F.least(F.floor(F.col("__sh_frac") * n), F.lit(n - 1)).alias("__sh_fb"))
    placed = _rank(placed, ["__sh_all"], "__sh_fb",
                   [F.col(c) for c in ("__sh_frac", "__sh_null", "__sh_src", "__sh_rank")], "__sh_count", "__sh_pos")
    shard = F.expr(f"((__sh_pos - 1) * {shards}) div __sh_count")
    first = F.expr(f"(__sh_shard * __sh_count + {shards - 1}) div {shards}")
    return (placed.withColumn("__sh_shard", shard)
            .select(*keep, F.col("__sh_shard").cast("int").alias("shard"),
                    (F.col("__sh_pos") - 1 - first).cast("long").alias("slot")))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The interleaved rows as Parquet, one folder per shard, each file in slot order."""
    (interleave(df, **options).repartition("shard", F.floor(F.col("slot") / 100_000))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The digest of op7: doc_id, size, text_crc32, law, shard, slot, grown_shard (law ``rows``: null), source."""
    payload = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    digest = docs.select("doc_id", "source", (F.octet_length(payload) + 1).cast("long").alias("size"),
                         F.crc32(payload).alias("text_crc32"))
    placed = interleave(digest, shards=shards, seed=seed, tie_cols=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")
