"""SparkSession factory with the settings the engine is tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins, splits skewed partitions and merges small ones at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it any more
}


def build_session(master: str | None = None, settings: dict[str, str] | None = None, name: str = "lanewise") -> SparkSession:
    """A session with ``SETTINGS``, overridden by ``settings``; the master is the cluster's unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def use_checkpoints(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the session's ``spark.checkpoint.dir``.

    Only a local session without one, as in tests, gets a temporary folder; on a cluster executors could not read it, and it is an error.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()
