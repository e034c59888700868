"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution decides joins from measured sizes: a side is broadcast only when its
# shuffled size is below the threshold, otherwise a (skew-split) sort-merge join runs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SMALL_SCAN = 16


def build_session(master: str | None = None, app_name: str = "jobloom", **conf: str) -> SparkSession:
    """A session with the library's settings; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a local one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="jobloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for tables one job writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/jobloom/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small scan over up to `SMALL_SCAN` cores before heavy work per row.

    A file with one row group is one task, whatever it holds. Inputs that come in `SMALL_SCAN` splits
    or more are returned unchanged however many cores there are, so no large table is shuffled.
    """
    cores = min(SMALL_SCAN, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in reliable storage, so iterations survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
