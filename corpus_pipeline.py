"""Corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from albumetry.llm import language, mixing, near_dedup, packing, suffixes
from albumetry.llm.queries import tokenizer
from albumetry.llm.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


REPEATED_WORDS = 51  # a repeated passage is over 50 words long
REPEATED_GRAM = 13  # words that name an anchor


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters and those far from every language go.

    Null and empty texts have no letter and go. Rows are judged one by one, so repeated rows and ids share a verdict; all columns
    stay as they are; an empty table gives no rows.
    """
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more.

    Null and empty texts, and texts without a word, are linked with nothing and stay. Of repeated rows one stays, also where
    ids are null or repeat; all columns stay as they are; an empty table gives no rows.
    """
    return near_dedup.one_of_each(docs, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur twice, in one document or in two.

    Every word goes that lies in a run of 51 words (``[^\\x20\\x09-\\x0D]+``, as they are written, whatever stands between
    them) which also starts elsewhere in the stage's input. Null texts stay null; documents that lose all stay, empty; rows that
    repeat are copies of each other and lose what they share; ``n_chars`` follows the text; all other columns stay.
    """
    return suffixes.without_repeats(docs, length=REPEATED_WORDS, gram=REPEATED_GRAM, unit=suffixes.WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken.

    Null and empty texts have no words, so they cost nothing and follow their source's share. A null source is one of its own;
    repeated rows are documents each; all columns stay as they are; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null and empty texts are the closing id alone; repeated rows and ids are packed each; columns other than doc_id and text are
    not needed; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mix sources", mix_sources),
    ("packing", pack_sequences),
]

# language models and suffix refinement have no SQL form; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
