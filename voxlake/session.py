"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "voxlake", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session with the settings the operators are tuned for.

    On a cluster the session comes from spark-submit; only the settings below
    that do not depend on the machine are worth copying there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # bounded groups are collected by X1; keep them on the hash path
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the master
    is local (tests); on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured
