"""Library analytics: overview, formats, capacity, duplicate totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import quality as Q
from albumetry.functions.text import extension
from albumetry.operators import groups as G


def overview(assets: DataFrame, now: Column, custom_collections: int = 0) -> DataFrame:
    """One row over the whole catalog (deleted rows give the trash count).

    Needs is_favourite; time is created_at, else taken_at."""
    live = ~F.col("is_deleted")
    age = F.unix_micros(now) - F.unix_micros(F.coalesce("created_at", "taken_at"))
    within = lambda days: F.count_if(live & (age <= days * 86_400_000_000))
    return assets.agg(
        F.count_if(live).alias("photos"),
        F.coalesce(F.sum(F.when(live, F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.count_if(live & F.coalesce(F.col("is_favourite"), F.lit(False))).alias("favourites"),
        within(30).alias("added_30_days"),
        within(7).alias("added_7_days"),
        F.count_if(F.col("is_deleted")).alias("deleted"),
        F.lit(len(vocab.DEFAULT_COLLECTIONS) + custom_collections).cast("long").alias("collections"),
    )


def duplicate_totals(items: DataFrame) -> DataFrame:
    """Extra copies and bytes they take: hashes within 4, else same size and name."""
    grouped = G.copy_groups(G.copy_items(items, same_time=False), vocab.NEAR_RADIUS)
    saved = G.group_savings(G.group_members(grouped, items))
    return saved.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("items") - 1), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum("savings"), F.lit(0)).alias("duplicate_savings"),
    )


def low_quality(items: DataFrame) -> DataFrame:
    return items.filter(Q.is_low_quality_by_issue(F.col("quality_grade"), F.col("issues")))


def documents(items: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce("document_type", F.lit("")))
    hit = ((kind != "") & (kind != "screenshot")) | (F.length("detected_text") > 50) | (F.col("media_type") == "DOCUMENT")
    return items.filter(F.coalesce(hit, F.lit(False)))


def format_name(filename: Column, media_type: Column) -> Column:
    ext = extension(filename)
    ext = F.when(ext == "", "JPEG").otherwise(ext)
    return (
        F.when(ext == "JPG", "JPEG")
        .when(ext.isin("PNG", "WEBP", "HEIC", "GIF", "BMP"), ext)
        .when((media_type == "VIDEO") | ext.isin("MP4", "MOV", "AVI", "MKV"), "Videos")
        .otherwise("Other")
    )


def format_breakdown(items: DataFrame) -> DataFrame:
    return items.groupBy(format_name(F.col("filename"), F.col("media_type")).alias("format")).agg(
        F.count("*").alias("items")
    )


def capacity(items: DataFrame, total: int = vocab.CAPACITY_BYTES) -> DataFrame:
    """Used share (at least 0.5 % once anything is stored) and what remains."""
    used = F.coalesce(F.sum("file_size"), F.lit(0))
    share = F.greatest(F.when(used > 0, 0.5).otherwise(0.0), used / F.lit(total) * 100)
    return items.agg(
        used.alias("used_bytes"),
        F.round(F.least(F.lit(100.0), share), 6).alias("used_percentage"),
        F.greatest(F.lit(0).cast("long"), F.lit(total) - used).alias("remaining_bytes"),
    )


def cache_estimate(items: DataFrame) -> DataFrame:
    return items.agg((F.count("*") * vocab.THUMBNAIL_BYTES).alias("cache_bytes"))


def potential_savings(items: DataFrame) -> DataFrame:
    """Duplicate savings plus bytes of low-quality items."""
    blurry = low_quality(items).agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("low_quality_bytes"))
    # two one-row aggregates side by side
    return duplicate_totals(items).join(F.broadcast(blurry)).withColumn(
        "potential_savings", F.col("duplicate_savings") + F.col("low_quality_bytes")
    )
