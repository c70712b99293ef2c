"""Queries ``opN_<name>`` over the driver's tables, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm import chroma, lm_score, toxicity
from locusforge.llm.byte_bpe import ByteBpe
from locusforge.llm.common import fresh_path, spread, table
from locusforge.llm.exact_dedup import exact_duplicates
from locusforge.llm.html_text import extract_text
from locusforge.llm.license_scan import scan_licenses
from locusforge.llm.mixing import mixture
from locusforge.llm.sharding import ShardStore, arrive
from locusforge.llm.simhash import near_duplicates


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty; rows that repeat share a group; an empty table gives no rows."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def _remainder(modulus: int = 5):
    """crc32 of the identifier as text, modulo 5; the contract's split into training and held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a document without terms; a row without identifier is not held out."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    machine = toxicity.fit(documents, table(spark, sf_dir, "labels").where(_remainder() != 0))
    scored = toxicity.score(documents, machine, score_col="score")
    return scored.select("doc_id", (F.coalesce(_remainder(), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Telephone-like settings for recordings made of short tones.
TONES = chroma.Settings(rate=4000, frame=1024, hop=256, low=100.0, high=1900.0)


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` sounded as a tone series; those with an id divisible by 100 are searched among all."""
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), media_col="embedding", id_col="vec_id", settings=TONES, reader=chroma.tone_series)
    found = chroma.align(prints, F.col("media_id") % 100 == 0, most_error=0.25, least_overlap=48)
    return found.withColumnRenamed("media_id", "vec_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty: no ids, and the digests of nothing; rows that repeat are encoded each."""
    bpe = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages have the empty text; rows that repeat are read each."""
    return extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text has size 0, a null source is one of its own and the last; rows that repeat share their fate."""
    found = mixture(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty: one token, the end; a row without identifier trains."""
    held_out = _remainder() == 1
    return lm_score.score(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), held_out, tokenizer_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals of ``documents``, compacted after each; where each document lies in the last version."""
    store = ShardStore(spark, fresh_path(spark, "shards"), target_bytes=64 << 20, fan_in=4, least_bytes=1 << 20)
    return arrive(store, table(spark, sf_dir, "documents"), arrivals=4).placement()


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text has no words, no places and empty labels; rows that repeat are scanned each."""
    return scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).drop("detections")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text and text without words share fingerprint zero; rows that repeat an identifier keep a row each."""
    found = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), words=4, seed=42, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_chroma, op4_byte_bpe, op5_html_text, op6_mixing, op7_lm_score, op8_sharding, op9_license_scan, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
    }
