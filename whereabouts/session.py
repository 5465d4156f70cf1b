"""The one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="whereabouts-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, placed: bool = False) -> DataFrame:
    """Rows written and read again, without what made them.

    ``placed`` keeps what is known of where rows lie, which is lost under adaptive execution: what later goes by the key
    of their last shuffle moves none of them.
    """
    checkpoint_dir(df.sparkSession)
    if not placed:
        return df.checkpoint()
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
