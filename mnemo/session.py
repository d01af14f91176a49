"""Spark session helpers.

Everything in the package runs on whatever session the caller passes in.
``get_session`` only exists for tests, benches and scripts: it builds a
local session with the settings the library relies on (UTC session time
zone, adaptive execution) and fills in a checkpoint folder only when the
cluster has not named one.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library's semantics depend on. Timestamps are formatted as
# ISO-8601 UTC strings, so the session time zone must be UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Seed-id lists (at most the search limit cap, 200) are pushed into
    # Parquet as per-value tests, so row groups are skipped by their
    # min/max; past the default of 10 values Spark would only push the
    # list's overall min/max, which skips almost nothing for scattered ids.
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "mnemo") -> SparkSession:
    master = master or os.environ.get("MNEMO_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the library needs to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    cluster (a shared file system); without it nothing can be exchanged
    between executors, so a cluster session that lacks it is an error. Only
    a session whose driver and executors are one process (``local`` masters,
    as in tests) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="mnemo-ckpt-", dir=os.environ.get("MNEMO_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
