"""Quality assessment: provider results → fused scores, grade, issues, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import quality as Q
from albumetry.operators.scale import upsert

DIMENSIONS = ["sharpness", "exposure", "aesthetic", "resolution"]


def validate_weights(weights: dict[str, float], providers: list[str]) -> None:
    """Checked before any plan is built."""
    if not providers:
        raise ValueError("at least one quality provider is needed")
    total = sum(weights[d] for d in DIMENSIONS)
    if abs(total - 1.0) > 0.01:
        raise ValueError(f"quality weights must sum to 1.0, got {total:.4f}")


def reuse_metrics(assets: DataFrame) -> DataFrame:
    """Stored metrics win over computed ones, per key, with a source flag."""
    out = assets
    for key in ("brightness", "blur_score", "sharpness"):
        out = out.withColumn(f"{key}_source", F.when(F.col(f"stored_{key}").isNotNull(), 0).otherwise(1))
        out = out.withColumn(key, F.coalesce(f"stored_{key}", f"computed_{key}"))
    return out


def classical_result(metrics: DataFrame) -> DataFrame:
    """Provider rows from pixel metrics: asset_id, width, height, brightness, sharpness, blur_score."""
    s, b = F.col("sharpness"), F.col("brightness")
    return metrics.select(
        "asset_id",
        F.lit("classical_cv").alias("provider"),
        F.lit("1.0").alias("version"),
        (s.isNotNull() & b.isNotNull()).alias("is_available"),
        F.round(Q.sharpness_score(s), 4).alias("sharpness"),
        F.round(Q.exposure_score(b), 4).alias("exposure"),
        F.lit(None).cast("double").alias("aesthetic"),
        F.round(Q.resolution_score(F.col("width"), F.col("height")), 4).alias("resolution"),
        F.when(s.isNotNull() & b.isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
        F.round(b, 4).alias("brightness"),
        F.round(F.coalesce("blur_score", Q.blur_score(s)), 4).alias("blur_score"),
    )


def aesthetic_result(scores: DataFrame) -> DataFrame:
    """Provider rows from (asset_id, aesthetic)."""
    none = F.lit(None).cast("double")
    return scores.select(
        "asset_id", F.lit("clip_iqa").alias("provider"), F.lit("1.0").alias("version"),
        F.col("aesthetic").isNotNull().alias("is_available"),
        none.alias("sharpness"), none.alias("exposure"), F.round("aesthetic", 4).alias("aesthetic"),
        none.alias("resolution"), F.when(F.col("aesthetic").isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
        none.alias("brightness"), none.alias("blur_score"),
    )


def fuse_providers(results: DataFrame, providers: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Confidence-weighted scores per asset, one partial aggregation.

    results: asset_id, provider, is_available, the four scores, confidence,
    brightness, blur_score. The order of ``providers`` decides whose raw signal
    is taken first.
    """
    w = weights or vocab.QUALITY_WEIGHTS
    validate_weights(w, providers)
    usable = F.col("is_available") & (F.col("confidence") > 0)
    place = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))

    def mean(name: str) -> list[Column]:
        use = usable & F.col(name).isNotNull()
        return [
            F.sum(F.when(use, F.col(name) * F.col("confidence"))).alias(f"_{name}_s"),
            F.sum(F.when(use, F.col("confidence"))).alias(f"_{name}_w"),
        ]

    def first_signal(name: str) -> Column:
        known = F.col("is_available") & F.col(name).isNotNull()
        return F.min(F.when(known, F.struct(place.alias("place"), F.col(name).alias("v"))))["v"].alias(f"raw_{name}")

    sums = results.groupBy("asset_id").agg(
        *[c for d in DIMENSIONS for c in mean(d)],
        F.coalesce(F.sum(F.when(F.col("is_available"), F.col("confidence"))), F.lit(0.0)).alias("_conf"),
        F.max(usable).alias("_any"),
        first_signal("brightness"), first_signal("blur_score"),
    )

    def score(name: str) -> Column:
        enough = F.col(f"_{name}_w") >= 1e-8
        return F.when(enough, F.col(f"_{name}_s") / F.col(f"_{name}_w")).otherwise(0.5)

    out = sums.withColumns({d: score(d) for d in DIMENSIONS})
    overall = Q.overall_score(*[F.col(d) for d in DIMENSIONS], weights=w)
    return out.select(
        "asset_id", *DIMENSIONS,
        F.when(F.col("_any"), overall).otherwise(0.5).alias("overall"),
        F.when(F.col("_any"), Q.clamp(F.col("_conf") / len(providers))).otherwise(0.0).alias("confidence"),
        "raw_brightness", "raw_blur_score",
    )


def assess(assets: DataFrame, results: DataFrame, providers: list[str], existing: DataFrame | None = None,
           weights: dict[str, float] | None = None) -> DataFrame:
    """One assessment per asset; assets without any result get the neutral one.

    existing: asset_id, brightness, blur_score already stored; these win as raw
    signals. Grade and issues use the unrounded scores.
    """
    out = assets.select("asset_id").join(fuse_providers(results, providers, weights), "asset_id", "left")
    if existing is not None:
        stored = existing.select("asset_id", F.col("brightness").alias("_b"), F.col("blur_score").alias("_r"))
        out = out.join(stored, "asset_id", "left")
    else:
        out = out.withColumns({"_b": F.lit(None).cast("double"), "_r": F.lit(None).cast("double")})
    out = out.withColumn("_none", F.col("confidence").isNull())
    out = out.withColumns({name: F.coalesce(name, F.lit(0.5)) for name in [*DIMENSIONS, "overall"]})
    out = out.withColumns(
        {
            "brightness": F.when(F.col("_none"), 0.5).otherwise(F.coalesce("_b", "raw_brightness", F.lit(0.5))),
            "blur_score": F.when(F.col("_none"), 0.0).otherwise(F.coalesce("_r", "raw_blur_score", F.lit(0.0))),
        }
    )
    found = Q.issues(*[F.col(d) for d in DIMENSIONS], F.col("brightness"), F.col("blur_score"))
    out = out.withColumn("issues", F.when(F.col("_none"), F.array(F.lit("UNKNOWN"))).otherwise(found))
    out = out.withColumn("quality_grade", Q.grade(F.col("overall")))
    advice = F.when(F.col("_none"), "Quality assessment could not be completed.").otherwise(
        Q.recommendation(F.col("quality_grade"), F.col("issues"))
    )
    return out.select(
        "asset_id",
        F.round("overall", 4).alias("overall_score"),
        *[F.round(d, 4).alias(f"{d}_score") for d in DIMENSIONS],
        F.round("blur_score", 4).alias("blur_score"),
        F.round("brightness", 4).alias("brightness_score"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"),
        "quality_grade", "issues", advice.alias("recommendation"),
    )


def upsert_quality(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["asset_id"])


def quality_of(quality: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows only; nothing is computed."""
    return quality.join(ids.select("asset_id"), "asset_id", "left_semi")


def raster_metrics(rasters: DataFrame) -> DataFrame:
    """Pixel metrics of grey rasters: asset_id, brightness, darkness, sharpness, edge_stddev_cropped, blur_score.

    ``rasters``: asset_id, width, height, data (binary, row by row). Column expressions alone: one row per pixel within a task, added
    up per raster before the shuffle; an empty or missing raster gets the defaults of an image that cannot be decoded.
    """
    from albumetry.functions import raster as P

    i, at, row, numbers, width, height = (F.col(c) for c in ("_i", "_at", "_row", "_numbers", "width", "height"))
    last = F.octet_length("data") - 1
    good = F.coalesce(last >= 0, F.lit(False))
    pixels = (
        rasters.select("asset_id", F.monotonically_increasing_id().alias("_raster"), "width", "height",
                       F.when(good, P.packed(F.col("data"))).alias("_numbers"), F.when(good, F.sequence(F.lit(0), last)).alias("_places"))
        .select("asset_id", "_raster", "width", "height", "_numbers", F.explode_outer("_places").alias("_i"))
        .withColumns({"_row": F.floor(i / width).cast("int"), "_above": P.triple(numbers, i - width), "_here": P.triple(numbers, i),
                      "_below": P.triple(numbers, i + width)})
        .withColumn("_at", i - row * width)
        .select("asset_id", "_raster", P.level(F.col("_here")).alias("_grey"), P.inner(at, row, width, height).alias("_inner"),
                P.edge_level(F.col("_above"), F.col("_here"), F.col("_below"), at, row, width, height).alias("_edge"))
    )
    out = pixels.groupBy("asset_id", "_raster").agg(F.struct(
        P.sums(F.col("_grey")).alias("grey"),
        F.struct(P.sums(F.col("_edge")).alias("all"), P.sums(F.when(F.col("_inner"), F.col("_edge"))).alias("inner")).alias("edges")).alias("p"))
    brightness = F.col("p.grey.s") / F.col("p.grey.n") / 255.0
    sharpness = P.deviation(F.col("p.edges.all"))
    return out.select(
        "asset_id", F.coalesce(P.rounded(brightness, 4), F.lit(0.5)).alias("brightness"),
        F.coalesce(P.rounded(1.0 - brightness, 4), F.lit(0.5)).alias("darkness"),
        F.coalesce(P.rounded(sharpness, 4), F.lit(10.0)).alias("sharpness"),
        P.rounded(P.deviation(F.col("p.edges.inner")), 4).alias("edge_stddev_cropped"),
        F.coalesce(P.rounded(Q.blur_score(sharpness), 4), F.lit(50.0)).alias("blur_score"),
    )
