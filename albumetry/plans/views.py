"""Catalog views derived from the supplied tables, by plain projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.hashes import ahash64
from albumetry.functions.text import let

EPOCH = "2024-01-01 00:00:00"
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _plus(seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(at(EPOCH)) + seconds)


def _pick(c: Column, options: dict, default) -> Column:
    chain = None
    for key, value in options.items():
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(c == key, value) if chain is None else chain.when(c == key, value)
    return chain.otherwise(default)


def words(text: Column, low: int, high: int) -> Column:
    """Distinct lower-case words of low..high letters, sorted."""
    return F.sort_array(
        F.array_distinct(
            F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= low) & (F.length(w) <= high))
        )
    )


def letter_grid(text: Column, n: Column, cells: int = 64) -> Column:
    """Count of the letter e in equal slices of the whole text of n characters: a small raster.

    Characters beyond ASCII are replaced by one byte each, so that a slice is found by its place and not by walking there.
    """

    def slices(narrow: Column) -> Column:
        def cell(i: Column) -> Column:
            lo = F.floor(i * n / cells).cast("int")
            hi = F.floor((i + 1) * n / cells).cast("int")
            return let(
                F.substring(narrow, lo + 1, hi - lo).cast("string"),
                lambda part: (F.octet_length(part) - F.octet_length(F.replace(part, F.lit("e"), F.lit("")))).cast("double"),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell)

    ascii_only = F.octet_length(text) == F.char_length(text)
    return let(F.when(ascii_only, text).otherwise(F.regexp_replace(text, "[^\\x00-\\x7F]", "?")).cast("binary"), slices)


def asset_columns() -> dict[str, Column]:
    d, n = F.col("doc_id"), F.col("n_chars")
    prefix = _pick(n % 7, {0: "dark_", 1: "resized_", 2: "screenshot_"}, "")
    copy = _pick(n % 3, {0: " (copy 1)"}, "")
    ext = _pick(n % 5, {0: ".jpg", 1: ".png", 2: ".jpeg", 3: ".webp"}, ".mp4")
    deleted = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return {
        "asset_id": d,
        "filename": F.concat(prefix, F.col("source"), F.lit("_"), F.col("lang"), copy, ext),
        "media_type": F.lit("PHOTO"),
        "file_size": F.octet_length("text").cast("long"),
        "status": _pick(F.col("quality"), {1: "READY", 0: "FAILED"}, "UPLOADED"),
        "taken_at": _plus(n),
        "created_at": _plus(d * 60),
        "is_deleted": deleted,
        "deleted_at": F.when(deleted, _plus(n * 60)),
        "deleted_from": F.when(deleted, F.col("source")),
        "width": (n + 1000).cast("int"),
        "height": (n % 1000 + 500).cast("int"),
    }


def assets(spark: SparkSession, sf_dir: str, content_hash: bool = False, p_hash: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    cols = asset_columns()
    if content_hash:
        cols["file_hash"] = F.sha2("text", 256)
    if p_hash:
        cols["p_hash"] = ahash64(letter_grid(F.col("text"), F.col("n_chars")))
    return docs.join(labels, "doc_id", "left").select(*[c.alias(k) for k, c in cols.items()])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge records: whole text as caption, whole page as detected text."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("detected_text"))
    text, lang, n = F.col("text"), F.col("lang"), F.col("n_chars")
    number = F.regexp_extract("source", "(\\d+)$", 1).cast("int")
    scene = F.get(F.array(*[F.lit(s) for s in vocab.SCENES]), number % len(vocab.SCENES))
    colour = {"en": ["red", "blue"], "fr": ["black", "white"], "de": ["green", "brown"]}
    return docs.join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("asset_id"),
        text.alias("caption"),
        "detected_text",
        scene.alias("scene"),
        words(text, 12, 10_000).alias("objects"),
        words(text, 10, 11).alias("keyword_tags"),
        words(text, 9, 9).alias("keyword_keys"),
        _pick(lang, {"fr": "receipt", "de": "letter", "es": "other"}, F.lit(None).cast("string")).alias("document_type"),
        _pick(n % 4, {0: "birthday", 1: "new_year", 2: "travel"}, F.lit(None).cast("string")).alias("event_type"),
        _pick(lang, {"en": "outdoor", "fr": "indoor"}, F.lit(None).cast("string")).alias("indoor_outdoor"),
        F.lit(None).cast("boolean").alias("is_indoor"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("people_count"),
        _pick(lang, {k: F.array(*[F.lit(c) for c in v]) for k, v in colour.items()}, F.array(F.lit("blue"))).alias("dominant_colors"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as query texts, with the vector of the same number."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return bench.join(vec, "query_id")


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label: (label, embedding); ten rows."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        "label", F.transform("v", lambda s: s["x"]).alias("embedding")
    )


def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in pixel metrics per asset."""
    n, size = F.col("n_chars"), F.octet_length("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"),
        (n + 1000).cast("int").alias("width"), (n % 1000 + 500).cast("int").alias("height"),
        ((n % 101) / 100).alias("brightness"),
        (size % 67).cast("double").alias("sharpness"),
        F.lit(None).cast("double").alias("blur_score"),
    )


def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classical results for all assets, aesthetic results for labelled ones."""
    from albumetry.operators import quality as Q

    labels = table(spark, sf_dir, "labels")
    scores = labels.select(F.col("doc_id").alias("asset_id"), (F.col("quality") * 0.7 + 0.2 - F.col("toxic") * 0.1).alias("aesthetic"))
    return Q.classical_result(pixel_metrics(spark, sf_dir)).unionByName(Q.aesthetic_result(scores))


PROVIDERS = ["classical_cv", "clip_iqa"]


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assessments of the labelled assets."""
    from albumetry.operators import quality as Q

    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    return Q.assess(labelled, provider_results(spark, sf_dir).join(labelled, "asset_id", "left_semi"), PROVIDERS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active assets with hash, record and quality: what the recommendations read."""
    from albumetry.operators import catalog as C

    base = C.active(assets(spark, sf_dir, p_hash=True))
    return C.hydrate(base, None, records(spark, sf_dir), quality(spark, sf_dir).drop("confidence"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit(" "), k).alias("term"), "ts")


LIFECYCLE_STATES = {"view": "PROCESSING", "click": "PROCESSING", "signup": "UPLOADED", "purchase": "READY", "error": "FAILED"}
ANALYSIS_STATES = {"view": "PENDING", "click": "PROCESSING", "signup": "SKIPPED_NO_PROVIDER", "purchase": "COMPLETED", "error": "FAILED"}


def status_events(spark: SparkSession, sf_dir: str, states: dict[str, str]) -> DataFrame:
    return status_of(table(spark, sf_dir, "events"), states)


def status_of(e: DataFrame, states: dict[str, str]) -> DataFrame:
    """Status events of a table or stream of events."""
    state = _pick(F.col("event_type"), states, F.lit(None).cast("string"))
    return e.select(
        F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), state.alias("state"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed with "), "props")).alias("error"),
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as JSON text built from the documents; every third is fenced."""
    text, n, lang = F.col("text"), F.col("n_chars"), F.col("lang")
    scene = F.get(F.array(*[F.lit(s) for s in vocab.SCENES]), (n % 21).cast("int"))
    body = F.to_json(
        F.struct(
            text.alias("caption"),
            F.concat(F.lit("  "), F.upper(scene), F.lit(" ")).alias("scene"),
            F.split(text, " ").alias("objects"),
            F.split(text, "\n").alias("activities"),
            F.array(F.lpad(F.lower(F.hex(n)), 6, "0"), F.lit("zz"), F.lit("#ABCDEF")).alias("dominant_colors"),
            (n / 8).alias("people_count"),
            F.when(lang == "fr", "N/A").otherwise(lang).alias("location_guess"),
            F.when(n % 2 == 0, "Yes").otherwise("no").alias("travel_event"),
            F.split(text, "\\.").alias("keywords"),
            (n / 1000).alias("ai_confidence"),
        )
    )
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    broken = F.when(n % 3 == 0, fenced).when(n % 11 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(n % 13 == 0, text).otherwise(body)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_asset_id"), broken.alias("response"))
