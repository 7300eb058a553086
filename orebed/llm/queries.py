"""Queries of this subpackage over the tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import ann, bpe, decontam, divergence, langid, passages, pii, quality, repair, secrets, sharding, simhash, warc
from orebed.llm.kernels import bucket_of, documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leaked into documents."""
    return decontam.leaked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, with its size."""
    placed = sharding.placed(documents(spark, sf_dir), sharding.lookup_table(spark, sharding.shard_names()), "doc_id")
    return placed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.found(documents(spark, sf_dir), secrets.transition_ratios(secrets.samples(spark)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.scored(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs, held = documents(spark, sf_dir), F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    filters = langid.fit(docs.where(~held))
    return langid.predicted(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    import public_tokenizers

    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return passages.repeated_passages(documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.found(documents(spark, sf_dir))


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back from byte ranges of them."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each language's sources, and the terms that lead each source."""
    return divergence.audited(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_secrets": op3_secrets,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_pii": op9_pii,
    "op10_simhash_neardup": op10_simhash_neardup,
    "op11_warc": op11_warc,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding.oracle_sql(),
    "op3_secrets": secrets.oracle_sql(),
    "op11_warc": warc.oracle_sql(),
    "op12_conversation_repair": repair.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
