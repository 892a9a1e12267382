"""What the corpus operators share: session limits, cut lineage, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kokek.checkpoints import cut, shared_folder  # noqa: F401

#: Rows of text in one Arrow batch; keeps a batch of ordinary documents near 2 MB.
ARROW_ROWS = 512
#: A side of a join with at most this many rows of a few fixed-width columns is broadcast;
#: larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches by which texts reach Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the (materialised) side is counted to be small; else none, so that
    the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("shuffle_merge")


def whole(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns beside it can clash with none."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
