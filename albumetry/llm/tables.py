"""Reading the supplied tables and native expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetry.session import written

__all__ = ["read", "written", "SPACES", "word_count", "words", "unit_hash", "kept_whole", "text_batches"]

# ASCII white space that separates words: \x20 and \x09 to \x0D
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends at most ``BATCH`` rows at a time to Python, as rows may hold long texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def words(text: Column) -> Column:
    """Words of a text as an array; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(c: Column, bits: int = 36) -> Column:
    """Hash of a value as a number of ``bits`` bits (a multiple of 4), the same in every SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, bits // 4), 16, 10).cast("long")


def kept_whole(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns and all columns as one struct ``row``, so that added columns clash with none of the table's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)
