"""A Spark session with the settings that the engine is planned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; on a cluster the master and resources come from spark-submit."""
    builder = SparkSession.builder.appName("skeinwork")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the session's checkpoint folder. With a local
    master, where all is one machine, a folder of our own does if neither is set; a cluster must name one."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='skeinwork-')}"
    if not current.isDefined():
        context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so a lost executor costs no recomputation beyond this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
