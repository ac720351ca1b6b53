"""Image files, catalogs and partitioned output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from albumetry import schemas, vocab

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def is_image_path(path: Column) -> Column:
    return F.lower(path).rlike("\\.(" + "|".join(e[1:] for e in vocab.IMAGE_EXTENSIONS) + ")$")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files below ``path`` with their bytes; column pruning skips the bytes
    where they are not asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(is_image_path(F.col("path")))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, width (-1 if undecodable), height, channels, data (BGR bytes)."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return images.select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    ).filter(is_image_path(F.col("path")))


def decode_report(pixels: DataFrame) -> DataFrame:
    """Files read and files that could not be decoded."""
    return pixels.agg(F.count("*").alias("files"), F.count_if(F.col("width") <= 0).alias("undecodable"))


def directory_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Image files per directory; bytes are never read."""
    return category_counts(scan_files(spark, path).select("path"))


def category_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy(F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("category")).agg(
        F.count("*").alias("count")
    )


def read_catalog(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of the catalog tables with its declared schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{path}/{table}")


def write_partitioned(df: DataFrame, path: str, at: Column | None = None, mode: str = "append") -> None:
    """Writes below yyyy/mm folders of the write time (UTC)."""
    when = F.current_timestamp() if at is None else at
    dated = df.withColumns({"yyyy": F.date_format(when, "yyyy"), "mm": F.date_format(when, "MM")})
    dated.write.mode(mode).partitionBy("yyyy", "mm").parquet(path)


def write_manifest(summary: DataFrame, path: str, seconds: float) -> None:
    """The one-row ingest summary as JSON with completion time and duration."""
    done = summary.withColumns(
        {
            "completed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "processing_time_seconds": F.round(F.lit(float(seconds)), 2),
        }
    )
    done.coalesce(1).write.mode("overwrite").json(path)
