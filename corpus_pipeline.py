"""The corpus pipeline: quality rules, language, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
A stage works on every row that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm.language import UNDETERMINED, fit_on, identify
from retort.llm.lines import dedup_lines
from retort.llm.minhash import one_of_each
from retort.llm.packing import pack_documents
from retort.llm.quality import quality
from retort.llm.queries import BYTES
from retort.session import cut_lineage
from retort.ship import ship
from retort.sources.tables import table

#: A prediction below this is taken as no language.
LEAST_SCORE = 0.2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with limits from the distances of all."""
    return quality(docs, carry=tuple(docs.columns)).where("kept").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: not ``und``, which texts unlike those of every language are too, and a score of LEAST_SCORE or more."""
    model = fit_on(docs)
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    told = identify(packed, model, keep=("row",), reject=True)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has, n_chars counted anew; those left without a line go."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id; documents without an id come last."""
    return one_of_each(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, *BYTES, capacity=1024)


def _shipped(stage):
    """The stage with the package on the executors and Arrow batches bounded, whoever calls it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _shipped(stage))
    for name, stage in (
        ("quality", quality_stage),
        ("language", language_stage),
        ("line_dedup", line_stage),
        ("near_dedup", near_stage),
        ("packing", packing_stage),
    )
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", deal=True)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
