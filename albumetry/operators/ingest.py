"""Ingest: signature check, content hash, copies, registration, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.functions import text as X
from albumetry.functions.hashes import valid_signature
from albumetry.operators.scale import lookup_join, maybe_among
from albumetry.session import written


def fingerprint(files: DataFrame) -> DataFrame:
    """path, filename, file_size, file_hash, is_valid; the bytes are dropped here."""
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.length("content").cast("long").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"),
        valid_signature(F.col("content")).alias("is_valid"),
    )


def mark_copies(batch: DataFrame, catalog: DataFrame, by: str = "path") -> DataFrame:
    """Adds existing_id and outcome: new, skipped (known or copy in the batch) or failed.

    Hashes are reduced to one row each before they meet the catalog, so a hash
    on a large share of the batch is looked up once. The batch (names and hashes) is written once, so its contents are
    read and hashed once, whatever is then asked of it; of the catalog only rows that may match are joined.
    """
    batch = written(batch)
    valid = batch.filter("is_valid")
    classes = valid.groupBy("file_hash").agg(F.count("*").alias("n"), F.min(by).alias("first"))
    known = maybe_among(catalog.select("file_hash", F.col("asset_id").alias("existing_id")), classes, "file_hash")
    table = classes.join(known, "file_hash", "left")
    marked = lookup_join(valid, table, "file_hash", by)
    outcome = F.when(F.col("existing_id").isNotNull(), "skipped").when(F.col(by) == F.col("first"), "new").otherwise("skipped")
    done = marked.withColumn("outcome", outcome).drop("n", "first")
    refused = batch.filter(~F.col("is_valid")).withColumns(
        {"existing_id": F.lit(None).cast(catalog.schema["asset_id"].dataType), "outcome": F.lit("failed")}
    )
    return done.unionByName(refused)


def conflicts(marked: DataFrame) -> DataFrame:
    return marked.filter("existing_id is not null")


def register_assets(marked: DataFrame, now: Column | None = None, asset_id: Column | None = None) -> DataFrame:
    """Catalog rows of the new files, status UPLOADED.

    The id comes from the content hash, so a repeated run gives the same id."""
    when = F.current_timestamp() if now is None else now
    h = F.col("file_hash")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    return marked.filter("outcome = 'new'").select(
        (uuid if asset_id is None else asset_id).alias("asset_id"),
        "filename", X.mime_from_name(F.col("filename")).alias("mime_type"), F.lit("PHOTO").alias("media_type"),
        F.col("path").alias("original_path"), "file_size", "file_hash", F.lit("UPLOADED").alias("status"),
        when.alias("taken_at"), when.alias("created_at"), when.alias("updated_at"),
        F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_from"), F.lit(None).cast("string").alias("error_message"),
    )


def ingest_summary(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count("*").alias("total_images"),
        F.count_if(F.col("outcome") == "new").alias("imported"),
        F.count_if(F.col("outcome") == "skipped").alias("duplicates_skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds → decimal degrees; bad input gives null."""
    num = lambda c: c.try_cast("double")
    value = num(d) + num(m) / 60.0 + num(s) / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def _aperture(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("f/%.2f", F.bround(number, 2))).otherwise(c)


def _exif_time(c: Column) -> Column:
    return F.try_to_timestamp(X.strip(c), F.lit("yyyy:MM:dd HH:mm:ss"))


def normalise_exif(tags: DataFrame) -> DataFrame:
    """One row per asset from raw tags (asset_id, ifd, tag, value).

    ifd is base, exif or gps. Base values win, then the sub-blocks. Lists are
    given as comma-separated text. The tag set per asset is fixed and small.
    """
    wanted = {
        "base": ["Make", "Model", "ExposureTime", "FNumber", "ISOSpeedRatings", "DateTimeOriginal",
                 "GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef"],
        "exif": ["ExposureTime", "FNumber", "ISOSpeedRatings", "DateTimeOriginal"],
        "gps": ["GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef"],
    }
    # texts are aggregated by a sort: dealt out first, so that no task sorts all tags of the file it reads
    one = tags.repartition("asset_id").groupBy("asset_id").agg(
        *[
            F.max(F.when((F.col("ifd") == ifd) & (F.col("tag") == t), F.col("value"))).alias(f"{ifd}_{t}")
            for ifd, names in wanted.items() for t in names
        ]
    )

    def v(ifd: str, t: str) -> Column:
        return F.col(f"{ifd}_{t}")

    def first_number(c: Column) -> Column:
        return F.get(F.split(c, ","), F.lit(0)).try_cast("double").cast("int")

    def degrees(ifd: str, axis: str) -> Column:
        parts = F.split(v(ifd, f"GPS{axis}"), ",")
        at = lambda i: F.get(parts, F.lit(i))
        ref = v(ifd, f"GPS{axis}Ref")
        return F.when(ref.isNotNull(), dms_to_decimal(at(0), at(1), at(2), ref))

    iso_base = first_number(v("base", "ISOSpeedRatings"))
    lat_base = degrees("base", "Latitude")
    from_gps = lambda axis: F.when(  # noqa: E731 - the sub-block is read only without a base latitude
        lat_base.isNull() | (lat_base == 0), degrees("gps", axis)
    )
    return one.select(
        "asset_id",
        X.strip(v("base", "Make")).alias("camera_make"),
        X.strip(v("base", "Model")).alias("camera_model"),
        F.coalesce(v("base", "ExposureTime"), v("exif", "ExposureTime")).alias("exposure_time"),
        F.coalesce(_aperture(v("base", "FNumber")), _aperture(v("exif", "FNumber"))).alias("f_number"),
        F.coalesce(F.when(iso_base != 0, iso_base), first_number(v("exif", "ISOSpeedRatings")), iso_base).alias("iso_speed"),
        F.coalesce(from_gps("Latitude"), lat_base).alias("gps_latitude"),
        F.coalesce(from_gps("Longitude"), degrees("base", "Longitude")).alias("gps_longitude"),
        F.coalesce(_exif_time(v("base", "DateTimeOriginal")), _exif_time(v("exif", "DateTimeOriginal"))).alias("taken_at"),
    )


def effective_taken_at(assets: DataFrame, metadata: DataFrame) -> DataFrame:
    """Camera time where known, else what the catalog has."""
    seen = metadata.select("asset_id", F.col("taken_at").alias("_seen"))
    return assets.join(seen, "asset_id", "left").withColumn("taken_at", F.coalesce("_seen", "taken_at")).drop("_seen")


def migrate_paths(assets: DataFrame, root: str = "/storage/") -> DataFrame:
    """Rewrites both paths of rows whose original path is a host path."""
    host = X.is_host_path(F.col("original_path"))
    return assets.withColumns(
        {
            "thumbnail_path": F.when(host, X.migrated_path(F.col("thumbnail_path"), root)).otherwise(F.col("thumbnail_path")),
            "original_path": F.when(host, X.migrated_path(F.col("original_path"), root)).otherwise(F.col("original_path")),
        }
    )
