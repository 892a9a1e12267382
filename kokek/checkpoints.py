"""Where intermediate results go: a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder set on the context or named by ``spark.checkpoint.dir``. Only a local session, as
    in tests, may go without: it gets a temporary one. A cluster without the setting is an error,
    because a machine's own folder is lost with it."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    named = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kokek-")
    if held.isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
