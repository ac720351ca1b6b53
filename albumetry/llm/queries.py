"""Registered queries of the operators with production parameters, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetry.llm import (alignment, byte_bpe, html_text, language, mixing, near_dedup, oracles, packing, phrases, quality, sharding,
                           suffixes, topk, urls)
from albumetry.llm.tables import read, text_batches


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; it lies at the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """Pattern of the public byte-level vocabularies that cuts texts before any merge."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), similarity=0.85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(read(spark, sf_dir, "documents"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.drop("host", "host_rate")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), split_pattern()
    docs = text_batches(read(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = docs.select("doc_id", byte_bpe.encoded(F.col("text"), path, pattern).alias("ids"))
    return ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decoded(F.col("ids"), path, pattern), 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = alignment.align(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), split_pattern())
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_url_filter": op2_url_filter,
    "op3_top_k": op3_top_k,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_html_text": op8_html_text,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_host_quality": op10_host_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": oracles.URLS,
    "op3_top_k": oracles.TOP_K,
    "op6_mixing": oracles.MIXING,
    "op10_host_quality": oracles.QUALITY,
    "op12_collocations": oracles.PHRASES,
}
