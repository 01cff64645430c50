"""Session helpers.

The library never creates machine-local scratch space on a cluster: lineage
cuts (``DataFrame.checkpoint``) go to the shared folder the cluster names in
``spark.checkpoint.dir``. Only a ``local[...]`` session with no such setting
(tests, laptop runs) gets a private temporary folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "curbscope",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with sane defaults.

    What spark-submit or the cluster's defaults set stays as it is, the
    master and the number of shuffle partitions included; without a master
    the session is ``local[$BENCH_CPUS or *]``. ``master``,
    ``shuffle_partitions`` and ``extra`` override. An existing session keeps
    its own settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    # spark-submit and the cluster's defaults are known to the JVM. Without
    # any of them it is not started yet, so that driver memory can be set.
    submitted = SparkContext._gateway is not None or any(
        k in os.environ for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR"))
    if submitted:
        SparkContext._ensure_initialized()
    outside = SparkConf(loadDefaults=submitted)
    cpus = os.environ.get("BENCH_CPUS", "*")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    # local[*] is what spark-submit fills in where nothing names a master
    if master or outside.get("spark.master", "local[*]") == "local[*]":
        settings["spark.master"] = master or f"local[{cpus}]"
    here = settings.get("spark.master", outside.get("spark.master", "")).startswith("local")
    if here:   # one machine: its memory and as many partitions as it has cores
        settings["spark.driver.memory"] = os.environ.get("CURBSCOPE_DRIVER_MEMORY", "8g")
        settings["spark.sql.shuffle.partitions"] = "8" if cpus == "*" else str(max(int(cpus), 1))
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        if k == "spark.master" or not outside.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``checkpoint()`` at the shared folder named by the session.

    Reads ``spark.checkpoint.dir``; if it is unset, a local-mode session gets
    a fresh temporary folder, and any other master is an error (a local
    folder would not survive executor loss on a cluster).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder "
            "(e.g. an HDFS/S3 path) for lineage checkpoints")
    path = tempfile.mkdtemp(prefix="curbscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
