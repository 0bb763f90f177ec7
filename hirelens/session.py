"""Spark session and shared-folder helpers.

Jobs never create their own session on a cluster; ``get_session`` is for tests,
the bench and local runs. It only fills settings the environment left unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session time (oracle parity), AQE for runtime
# re-planning (coalescing, skew split, broadcast conversion by measured size).
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    master = master or os.environ.get("HIRELENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName("hirelens")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("HIRELENS_DRIVER_MEM", "16g"))
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """True for ``local`` and ``local[...]``; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; where it is unset, a scratch folder in
    local mode and an error on a cluster, whose executors could not read that folder."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d is None:
            # Unset is allowed only where driver and executors share one machine.
            if not is_local(sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can "
                                 f"read: the session runs on {sc.master}")
            d = tempfile.mkdtemp(prefix="hirelens-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/hirelens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back:
    cuts the lineage (a lost executor re-reads the files) and, unlike an eager
    ``checkpoint()``, computes the plan only once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
