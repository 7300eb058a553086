"""Corpus preparation: stages over documents, each written as Parquet and read again by the next.

Each stage takes any table with doc_id and text. Null texts count as empty (a null stays null where texts are returned), rows with a
null id stay wherever ids decide, repeated rows are near duplicates of each other, very long texts are read whole, and an empty
table gives an empty one. All stages but the last return the columns that they got, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import bpe, decontam, pii, quality, simhash
from orebed.llm.kernels import documents, ensure_checkpoint_dir, removed


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.fit(docs, labels.where(~quality.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaked."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and their lengths (where there is such a column) brought up to date."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("byte_bpe", byte_bpe),
]
#: Trained models and hash-based searches: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages hand over goes to the shared checkpoint folder, from which each is deleted when the next is written."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    out, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared}/{k}-{name}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return out
