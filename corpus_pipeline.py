"""The corpus pipeline: toxicity, quality rules, near-duplicates, secrets,
packing. Each stage works on all that the stage before it kept; its result is
written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import near_dedup, packing, quality, queries, secrets, toxicity
from tablelens.llm.common import stage, table

#: Column of a stage's verdicts; documents may have columns of any other name.
OWN = "__tl_verdict"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), out_col=OWN)
    return scored.where(F.col(OWN) < 0.5).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the classifier."""
    return quality.judge(docs, queries.quality_model(spark, sf_dir), out_col=OWN).where(F.col(OWN)["kept"]).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates."""
    return near_dedup.keep_one(docs).select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; their n_chars follow."""
    masked = secrets.mask(secrets.find_secrets(docs, out_col=OWN), spans_col=OWN)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.size(OWN) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 4096 tokens."""
    rows = packing.pack_documents(docs, queries.vocabulary(queries.WORD_BPE), end_id=2, capacity=4096)
    return rows.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

#: Learned scores, components and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
