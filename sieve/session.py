"""SparkSession helpers.

Library code never builds its own session: every public function takes the
caller's ``SparkSession``. ``local_session`` is for tests, the bench and the
examples; on a cluster the submitting user's session (and its
``spark.checkpoint.dir``) is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sieve") -> SparkSession:
    """A local-mode session with AQE on and the UI off (tests / bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A folder the caller has set on the SparkContext counts too. Only when there is
    neither, in local mode (tests), is a private folder created and registered; a
    cluster's own setting is never overridden.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster (e.g. on HDFS or S3); "
                           "a machine-local folder does not survive executor loss")
    path = tempfile.mkdtemp(prefix="sieve-ckpt-")  # local mode only (tests)
    spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scale_conf(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Session settings sized for ``input_bytes`` of (compressed) input.

    * scan splits of ``maxPartitionBytes`` (at least two waves over the cores,
      at most 512 MB);
    * shuffles start with one partition per ``target_partition_bytes`` of input
      (shuffled data is smaller than the input after pruning and partial
      aggregation) and AQE coalesces them towards the advisory size;
    * AQE skew join splits a partition 5x the median and above 512 MB.
    """
    cores = max(1, int(executor_cores_total))
    split = max(32 << 20, min(512 << 20, input_bytes // (2 * cores) or (32 << 20)))
    shuffle = max(cores, min(200_000, input_bytes // target_partition_bytes or cores))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(int(shuffle)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.files.maxPartitionBytes": str(int(split)),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }
