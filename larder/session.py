"""Session settings shared by tests, bench and examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every larder job relies on. AQE re-plans joins with runtime sizes
# (a shuffled side that turns out small becomes a broadcast; skewed shuffle
# partitions are split), so no operator needs to guess table sizes.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Extra settings for a cluster reading tens of terabytes: larger input
# splits and shuffle partitions sized by bytes (not by core count), so a
# task handles a few hundred MB and the task count stays manageable.
CLUSTER_PROFILE = {
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1GB",
}


def build_session(master: str | None = None, app: str = "larder",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None, cluster: bool = False) -> SparkSession:
    """Local or cluster session with larder's defaults.

    ``master`` is only set when given (a cluster launcher normally supplies
    it). ``shuffle_partitions`` should follow the data size: about
    2-3 x cores locally, and input size / 256 MB on a cluster
    (``cluster=True`` adds ``CLUSTER_PROFILE``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if cluster:
        conf.update(CLUSTER_PROFILE)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Taken from ``spark.checkpoint.dir`` (or the SparkContext). Only a local
    session without one gets a folder under the system temp dir; a cluster
    session without one is an error (a machine-local folder would not
    survive the loss of the machine).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return checkpoint_dir(spark)
    if sc.master == "local" or sc.master.startswith("local["):
        import tempfile
        return checkpoint_dir(spark, os.path.join(tempfile.gettempdir(), "larder-checkpoints"))
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and published table versions.

    Read from ``spark.checkpoint.dir``; the fallback is used only where the
    setting is absent (tests), and is then stored on the session and the
    SparkContext so ``DataFrame.checkpoint`` works.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        path = current
    else:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set and no fallback was given")
        path = fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path

