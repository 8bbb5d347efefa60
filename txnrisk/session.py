"""Session helpers.

Library code never creates a cluster session on its own; ``get_spark`` is
for tests, the bench and local runs. ``ensure_session_defaults`` is called
by loaders so results do not depend on how the caller configured the
session: timestamps are interpreted in UTC, and a checkpoint directory is
set only when the cluster has not named one.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

UTC = "UTC"


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    """Pin the session time zone to UTC (naive source timestamps are UTC)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` points at storage that all executors share and is
    used as is. Only a local session, whose one process is all there is, may
    leave it unset and gets a folder below its warehouse; on a cluster that
    is an error, because a machine's own folder loses rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint")
    return spark.sparkContext.getCheckpointDir()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "txnrisk") -> SparkSession:
    """Local/test session with the settings the library is tuned for."""
    master = master or os.environ.get("TXNRISK_MASTER", "local[*]")
    parts = shuffle_partitions or int(os.environ.get("TXNRISK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TXNRISK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def materialize(df):
    """Cut the lineage of ``df``: write it once as a Parquet table under the
    shared checkpoint folder and read that table back.

    Used where one intermediate feeds several passes (quantiles, splits,
    model fitting): the rows are computed exactly once (``Dataset.checkpoint``
    on an unpersisted plan would compute them twice), later passes read
    compressed columns with pushdown, and a lost executor is recovered from
    the files instead of by recomputing the windows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/materialized-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def discard(df) -> None:
    """Delete the files of a ``materialize``d table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("materialized-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
