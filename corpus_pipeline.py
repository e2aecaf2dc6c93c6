"""A cleaning pipeline over the documents table: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from millrace.llm.queries import quality_model
from millrace.llm.shared import Scratch, passing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score says reject go."""
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    return scored.where("score >= 0.7").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; all documents stay."""
    kept = line_dedup.dedup(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.keep_first(docs, k=5, num=80, den=100).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training schedule of what is left."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

#: The classifier has no SQL; each stage is tested against plain code, or against its operator's SQL over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; each result is written to the shared folder and read again, and what a
    stage wrote meanwhile, like the result before it, is removed then.

    Other columns of the table are left out.  Null and empty texts pass or fail by their quality score like others and
    have no words to schedule; rows that repeat an id share their fate in the join and in decontamination; of equal texts the
    smallest id stays; a null id is kept but never joined; an empty table gives an empty schedule.  Texts are read whole.
    """
    scratch, ahead = Scratch(spark, "pipeline"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES:
        with passing():
            docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(*ahead)
        ahead = [docs]
    return docs
