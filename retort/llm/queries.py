"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.chat import conversation_digests
from retort.llm.language import language_predictions
from retort.llm.licenses import scan_licenses
from retort.llm.lines import line_report
from retort.llm.media import media_digests
from retort.llm.minhash import near_duplicates
from retort.llm.oracles import ORACLES
from retort.llm.packing import pack_documents
from retort.llm.quality import quality
from retort.llm.spencode import encoding_digests
from retort.llm.tokencount import token_counts
from retort.sources.tables import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", deal=True), width=4, percent=80)


def op2_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", deal=True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents", deal=True))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", deal=True), PIECES, limit=4096)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", deal=True))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents", deal=True), PIECES)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(turns.unionByName(probe))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents", deal=True))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *BYTES, capacity=1024)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents", deal=True))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_distribution_quality,
        op3_language_id,
        op4_token_counts,
        op5_license_scan,
        op6_sentencepiece,
        op7_chat_format,
        op8_line_dedup,
        op9_best_fit_packing,
        op10_flac_media,
    )
}
