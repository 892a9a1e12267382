"""Annotation of a text stream: each micro-batch runs the batch operator unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kokek.functions.lexicon import Lexicon
from kokek.operators.render import Known, Scorer, annotate


def annotate_stream(docs: DataFrame, lexicon: Lexicon, path: str, checkpoint: str, weights: Scorer = None, known: Known | None = None) -> StreamingQuery:
    """Appends annotated documents as Parquet; a replayed batch overwrites its own folder. With ``known`` a
    batch searches only words that no batch had before."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch, lexicon, weights, known).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
