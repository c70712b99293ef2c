"""A training corpus from ``documents``: reject toxic ones, deduplicate, mix sources, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. What a stage returns is written as
Parquet and read again for the next; all stages but the last return the columns of ``documents``.

In every stage a null text counts as empty, rows that repeat are rows each, columns of any name are carried along, and an
empty table gives an empty one. What else holds stands with the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm import toxicity
from locusforge.llm.byte_bpe import ByteBpe
from locusforge.llm.common import fresh_path, table
from locusforge.llm.exact_dedup import drop_exact_duplicates
from locusforge.llm.mixing import mix
from locusforge.llm.simhash import drop_near_duplicates


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows (those with crc32 of the id, modulo 5, not 0) scores below one half.

    Empty texts get the score of a document without terms. Without labelled rows nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels), threshold=0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest identifier; empty texts are equal, and a null identifier yields to any other."""
    return drop_exact_duplicates(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar to 0.8 or more the one with the smallest identifier.

    Candidates meet through deletion variants of wide SimHashes and are confirmed on whole shingle sets; README and tests give
    the measured recall. Texts without words are one group; rows without identifier stay.
    """
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources by weights 1, 2, 3 takes them; a null source is one more, the last."""
    return mix(docs, weights=(1, 2, 3), most=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mixture; an empty text has no ids and the digest of nothing."""
    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Toxicity, the fingerprints' hash and the encoding have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
