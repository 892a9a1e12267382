"""A corpus pipeline of five stages; each one's Parquet is the next one's ``docs``."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from kokek.llm import mixing, near_dedup, pieces, pii, quality
from kokek.llm.common import shared_folder
from kokek.llm.queries import vocabulary

#: SQL can express neither the language model nor the dynamic programme.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the rules and lie in their language's perplexity band.

    Null, empty and very short texts go; a null language is a language of its own; repeated rows
    stay or go together; other columns pass through whatever their names; no rows give none.
    """
    return quality.passing(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at similarity 0.8 or more on five-word shingles.

    Texts without words are like no other and stay, as do rows without id; rows of one id are one
    document and stay or go together; other columns pass through; no rows give none.
    """
    return near_dedup.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind.

    Every row stays; null texts stay null and ``n_chars`` follows the new text; texts are searched
    whole; other columns pass through; no rows give none.
    """
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets.

    Null texts have size 0 and a null source is a source of its own; of repeated rows as many go
    in as the mix takes; other columns pass through whatever their names; no rows give none.
    """
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, round_trip, ids of every document of the mix.

    Null and empty texts have no pieces; each row is encoded for itself, whole; no rows give none.
    """
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``, each written to and read from the shared folder. A stage's
    input is removed once its output is complete; the last output stays for the caller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
