"""Knowledge records: parse, normalise, merge, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import records as R
from albumetry.functions.text import let

RECORD_FIELDS = [
    "caption", "detailed_description", "scene", "objects", "activities",
    "indoor_outdoor", "weather", "season", "dominant_colors", "people_count",
    "detected_text", "document_type", "event_type", "travel_event",
    "location_guess", "mood", "ai_confidence", "raw_response",
]


def _json(c: Column) -> Column:
    """Text → variant if the whole of it is one JSON value, else null.

    Spark's parser stops behind the first value and leaves the rest unread. So the text is parsed as the first of two values,
    of which the second, its own digest, must come right behind it.
    """
    digest = F.sha2(c, 256)
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), digest, F.lit('"]')))
    return let(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == digest, F.try_variant_get(v, "$[0]", "variant")))


def _object(c: Column) -> Column:
    """Cleaned text → variant if it is a JSON object, else null."""
    return F.when(c.startswith("{"), _json(c))


def parse_records(raw: DataFrame, text: str = "response") -> DataFrame:
    """Adds ``record`` (variant) and ``parse_error``; exactly one is set."""
    clean = R.unfenced(F.col(text))
    out = raw.withColumn("_clean", clean).withColumn("record", _object(F.col("_clean")))
    empty = F.col("_clean").isNull() | (F.col("_clean") == "")
    return out.withColumn(
        "parse_error",
        F.when(F.col("record").isNull(),
               F.when(empty, "Empty response received from provider.")
               .when(_json(F.col("_clean")).isNull(), "Failed to parse JSON response")
               .otherwise("Provider response parsed to non-object JSON structure.")),
    ).drop("_clean")


def parsed_only(raw: DataFrame, text: str = "response") -> DataFrame:
    """Rows with a valid record. Exploding a list of at most one parses every
    text once; a filter would be pushed down and parse it again."""
    record = let(R.unfenced(F.col(text)), _object)
    return raw.withColumn("record", F.explode(F.filter(F.array(record), lambda v: v.isNotNull())))


def _number(path: str):
    """JSON number, numeric text or boolean as a double."""
    v = F.col("record")
    as_bool = F.when(
        F.schema_of_variant(R.field(v, path, "variant")) == "BOOLEAN",
        R.field(v, path, "boolean").cast("double"),
    )
    return F.coalesce(as_bool, R.to_number(R.field(v, path)))


def normalise_records(raw: DataFrame, text: str = "response") -> DataFrame:
    """All fields of the record with every rule applied; error rows are left out."""
    v = F.col("record")
    limit, most = vocab.TEXT_LIMITS, vocab.LIST_LIMITS
    words = lambda path: R.field(v, path, "array<string>")
    keywords = R.field(v, "keywords", "variant")
    is_list = F.schema_of_variant(keywords).startswith("ARRAY")
    is_object = F.schema_of_variant(keywords).startswith("OBJECT")
    has_tags = is_object & R.field(v, "keywords.tags", "variant").isNotNull() & ~F.is_variant_null(
        R.field(v, "keywords.tags", "variant")
    )
    tags = F.when(is_list, R.norm_list(words("keywords"), most["keywords"])).when(
        has_tags, R.norm_list(words("keywords.tags"), most["keywords"])
    )
    passed_on = F.when(
        is_object & ~has_tags,
        F.map_keys(R.field(v, "keywords", "map<string,variant>")),
    )
    kept = [c for c in raw.columns if c != text]
    return parsed_only(raw, text).select(
        *kept,
        R.norm_string(R.field(v, "caption"), limit["caption"], True).alias("caption"),
        R.norm_string(R.field(v, "detailed_description"), limit["detailed_description"]).alias("detailed_description"),
        R.norm_enum(R.field(v, "scene"), vocab.SCENES).alias("scene"),
        R.norm_list(words("objects"), most["objects"]).alias("objects"),
        R.norm_list(words("activities"), most["activities"]).alias("activities"),
        R.norm_enum(R.field(v, "indoor_outdoor"), vocab.INDOOR_OUTDOOR).alias("indoor_outdoor"),
        R.norm_enum(R.field(v, "weather"), vocab.WEATHERS).alias("weather"),
        R.norm_enum(R.field(v, "season"), vocab.SEASONS).alias("season"),
        R.norm_colours(words("dominant_colors")).alias("dominant_colors"),
        R.norm_people(_number("people_count")).alias("people_count"),
        R.norm_string(R.field(v, "detected_text"), limit["detected_text"]).alias("detected_text"),
        R.norm_enum(R.field(v, "document_type"), vocab.DOCUMENT_TYPES).alias("document_type"),
        R.norm_enum(R.field(v, "event_type"), vocab.EVENT_TYPES).alias("event_type"),
        R.norm_bool(R.field(v, "travel_event")).alias("travel_event"),
        R.norm_string(R.field(v, "location_guess"), limit["location_guess"]).alias("location_guess"),
        R.norm_enum(R.field(v, "mood"), vocab.MOODS).alias("mood"),
        tags.alias("keyword_tags"),
        passed_on.alias("keyword_keys"),
        F.when(is_object, R.field(v, "keywords.p_hash")).alias("p_hash"),
        R.norm_confidence(_number("ai_confidence")).alias("ai_confidence"),
        F.to_json(v).alias("raw_response"),
    ).withColumn(
        "keyword_keys", F.when(F.col("keyword_tags").isNotNull(), F.array(F.lit("tags"))).otherwise(F.col("keyword_keys"))
    )


def merge_records(old: DataFrame, new: DataFrame, key: str = "media_asset_id") -> DataFrame:
    """Non-null new values win; the stored hash survives keywords without one."""
    fields = [c for c in RECORD_FIELDS if c in old.columns or c in new.columns]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])

    both = side(old, "o_").join(side(new, "n_"), key, "full_outer")

    def pick(c: str):
        options = [F.col(f"{p}{c}") for p, df in (("n_", new), ("o_", old)) if c in df.columns]
        return F.coalesce(*options)

    fresh_words = F.col("n_keyword_tags").isNotNull() | F.col("n_keyword_keys").isNotNull()
    with_hash = lambda keys: F.when(
        F.col("o_p_hash").isNotNull() & F.col("n_p_hash").isNull(), F.array_union(keys, F.array(F.lit("p_hash")))
    ).otherwise(keys)
    synced = F.when(
        F.col("n_indoor_outdoor").isNotNull(), F.col("n_indoor_outdoor") == "indoor"
    ).otherwise(F.col("o_is_indoor") if "is_indoor" in old.columns else F.lit(None).cast("boolean"))
    return both.select(
        key,
        *[pick(c).alias(c) for c in fields],
        synced.alias("is_indoor"),
        F.when(fresh_words, F.col("n_keyword_tags")).otherwise(F.col("o_keyword_tags")).alias("keyword_tags"),
        F.when(fresh_words, with_hash(F.col("n_keyword_keys"))).otherwise(F.col("o_keyword_keys")).alias("keyword_keys"),
        F.coalesce("n_p_hash", "o_p_hash").alias("p_hash"),
    )


def zero_shot_labels(scores: DataFrame, key: str = "asset_id") -> DataFrame:
    """Best label per asset and its softmax share.

    ``scores`` holds one row per (asset, label) with the similarity; the label
    set is a fixed small vocabulary, so groups are bounded.
    """
    best = scores.groupBy(key).agg(
        F.max(F.struct("similarity", (-F.col("label_no")).alias("first"), "label")).alias("best"),
        F.sum(F.exp(F.col("similarity"))).alias("total"),
    )
    return best.select(
        key,
        F.col("best.label").alias("label"),
        (F.exp(F.col("best.similarity")) / F.col("total")).alias("probability"),
    )


def describe_assets(assets: DataFrame) -> DataFrame:
    """Local description of an asset from label, colours, file name and shape.

    Needs asset_id, filename, width, height, scene_label, object_label, colours.
    """
    hints = R.filename_hints(
        F.col("filename"), F.col("width"), F.col("height"),
        R.map_scene(F.col("scene_label")), R.map_objects(F.col("object_label")),
    )
    return (
        assets.withColumn("_h", hints)
        .withColumn("document_type", R.map_document_type(F.col("object_label")))
        .withColumn("scene", F.col("_h.scene"))
        .withColumn("objects", F.col("_h.objects"))
        .withColumn(
            "caption",
            R.caption_template(F.col("objects"), F.col("scene"), F.get("colours", F.lit(0)),
                               F.col("document_type"), F.col("filename")),
        )
        .withColumn("indoor_outdoor", R.indoor_outdoor_of(F.col("scene")))
        .withColumn("keyword_keys", R.keyword_words(F.col("scene"), F.col("objects"), F.col("colours")))
        .drop("_h")
    )


def restore_hashes(records: DataFrame, hashes: DataFrame, key: str = "media_asset_id") -> DataFrame:
    """Set ``p_hash`` in the metric map of every hashed asset; other keys stay."""
    joined = hashes.select(key, F.col("p_hash").alias("_h")).join(records, key, "full_outer")
    changed = R.set_metric(F.col("metrics"), "p_hash", F.col("_h"))
    return joined.withColumn(
        "metrics", F.when(F.col("_h").isNotNull(), changed).otherwise(F.col("metrics"))
    ).drop("_h")


def backfill_status(records: DataFrame) -> DataFrame:
    """Skipped records that do have a caption count as completed."""
    stale = F.col("caption").isNotNull() & (F.col("processing_status") == "SKIPPED_NO_PROVIDER")
    return records.withColumns(
        {
            "processed_at": F.when(stale, F.col("analysis_timestamp")).otherwise(F.col("processed_at")),
            "processing_status": F.when(stale, "COMPLETED").otherwise(F.col("processing_status")),
        }
    )
