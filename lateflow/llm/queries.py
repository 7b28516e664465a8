"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateflow.llm import bpe, decontaminate, divergence, embeddings, jaccard, lm, merkle, oracle, pii, quality, sharding, suffixes, tokenfiles, toxicity
from lateflow.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def fold(n: int) -> Column:
    """crc32 of the id as text, mod ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"), held_out=fold(5) == 1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), n_shards=40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"), width=400)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(read(spark, sf_dir, "documents"), WORD_BPE, end_id=1)
    return tokenfiles.read_token_files(manifest, ids=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(fold(5) != 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels").where(fold(3) != 1))
    return quality.score_quality(docs, model).select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), BYTE_BPE, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), n=4, part=85, whole=100)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    return pii.find_pii(read(spark, sf_dir, "documents"), outputs=outputs)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    built = merkle.manifest(docs, altered={"text": merkle.lower_ascii(F.col("text"))}, where=fold(3) == 0)
    return built.proofs().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=30, top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_embeddings": op4_embeddings,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_bpe": op10_bpe,
    "op11_pii": op11_pii,
    "op12_merkle": op12_merkle,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
