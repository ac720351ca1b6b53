"""Quality scores, grades, issues and texts as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.text import empty_words
from albumetry.functions.vectors import logistic

T = vocab.QUALITY_THRESHOLDS


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value inside the bounds; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def sharpness_score(edge_stddev: Column) -> Column:
    return logistic(0.12 * (edge_stddev - 20.0))


def exposure_score(brightness: Column) -> Column:
    return clamp((F.cos((brightness - 0.5) * (2.0 * math.pi)) + 1.0) / 2.0)


def resolution_score(width: Column, height: Column) -> Column:
    megapixels = width.cast("double") * height.cast("double") / 1_000_000.0
    return clamp(megapixels / T["full_megapixels"])


def blur_score(edge_stddev: Column) -> Column:
    return clamp(100.0 - edge_stddev * 3.0, 0.0, 100.0)


def overall_score(sharpness: Column, exposure: Column, aesthetic: Column, resolution: Column,
                  weights: dict[str, float] | None = None) -> Column:
    w = weights or vocab.QUALITY_WEIGHTS
    return clamp(
        F.lit(w["sharpness"]) * sharpness + F.lit(w["exposure"]) * exposure
        + F.lit(w["aesthetic"]) * aesthetic + F.lit(w["resolution"]) * resolution
    )


def grade(overall: Column) -> Column:
    chain = None
    for name, floor in vocab.GRADES:
        chain = F.when(overall >= floor, name) if chain is None else chain.when(overall >= floor, name)
    return chain.otherwise(vocab.WORST_GRADE)


def issues(sharpness: Column, exposure: Column, aesthetic: Column, resolution: Column,
           brightness: Column, blur: Column) -> Column:
    """Detected problems in fixed order; obstruction hides the others."""
    focus = F.when((blur > T["very_blurry"]) & (sharpness < 0.35), "MOTION_BLUR").when(
        sharpness < 0.20, "OUT_OF_FOCUS"
    )
    found = F.array(
        F.when((brightness < T["brightness_low"]) & (aesthetic < 0.45), "LOW_EXPOSURE"),
        F.when((brightness > T["brightness_high"]) & (exposure < 0.40), "OVER_EXPOSURE"),
        focus,
        F.when(resolution < T["min_megapixels"] / T["full_megapixels"], "LOW_RESOLUTION"),
    )
    obstructed = (brightness < 0.05) & (sharpness < 0.15)
    return F.when(obstructed, F.array(F.lit("LENS_OBSTRUCTION"))).otherwise(F.array_compact(found))


def recommendation(grade_col: Column, issue_list: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in vocab.ISSUE_TEXTS.items() for x in kv])
    joined = F.array_join(
        F.transform(issue_list, lambda i: F.coalesce(F.try_element_at(labels, i), i)), " and "
    )
    return (
        F.when(F.size(issue_list) > 0,
               F.concat(F.lit("This image "), joined, F.lit(". Consider reviewing or replacing it.")))
        .when(grade_col.isin("EXCELLENT", "GOOD"),
              "This image appears to be high quality with no detected problems.")
        .otherwise("Image quality is acceptable; no specific issues detected.")
    )


def grade_weight(grade_col: Column) -> Column:
    g = F.upper(grade_col)
    chain = F.when(g == vocab.WORST_GRADE, 1)
    for rank, (name, _) in zip((5, 4, 3, 2), vocab.GRADES):
        chain = chain.when(g == name, rank)
    return chain.otherwise(9)


def is_low_quality(grade_col: Column, overall: Column) -> Column:
    g = F.upper(grade_col)
    return F.coalesce(
        F.when(g.isin("GOOD", "EXCELLENT"), False)
        .when(g.isin("POOR", "VERY_POOR"), True)
        .otherwise(overall < 0.45),
        F.lit(False),
    )


def is_low_quality_by_issue(grade_col: Column, issue_list: Column) -> Column:
    g = F.upper(grade_col)
    bad = F.arrays_overlap(issue_list, F.array(F.lit("MOTION_BLUR"), F.lit("OUT_OF_FOCUS"), F.lit("LOW_RESOLUTION")))
    return F.coalesce(
        F.when(g.isin("GOOD", "EXCELLENT"), False)
        .when(g.isin("POOR", "VERY_POOR"), True)
        .otherwise(bad),
        F.lit(False),
    )


def quality_reasons(issue_list: Column, sharpness: Column, exposure: Column, resolution: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in vocab.REVIEW_LABELS.items() for x in kv])
    named = F.array_distinct(
        F.transform(
            F.coalesce(issue_list, empty_words()),
            lambda i: F.coalesce(F.try_element_at(labels, i), F.lower(F.translate(i, "_", " "))),
        )
    )
    by_score = F.array_compact(
        F.array(
            F.when(sharpness < 0.3, "Low sharpness"),
            F.when(exposure < 0.3, "Poor exposure"),
            F.when(resolution < 0.2, "Low resolution"),
        )
    )
    return F.when(F.size(named) > 0, named).otherwise(by_score)


def pixel_labels(status: Column, sharpness: Column, brightness: Column, darkness: Column,
                 blur: Column, width: Column, height: Column) -> Column:
    """Badges; metrics of completed records are ignored."""
    def metric(c: Column, default: float) -> Column:
        hidden = F.coalesce(status == "COMPLETED", F.lit(False))
        return F.when(hidden, F.lit(default)).otherwise(F.coalesce(c, F.lit(default)))

    sharp = metric(sharpness, 0.0)
    stars = (
        F.when(sharp >= 45, "★★★★★ Sharp").when(sharp >= 30, "★★★★☆ Sharp")
        .when(sharp >= 15, "★★★☆☆ Moderate").otherwise("★★☆☆☆ Soft")
    )
    return F.array_compact(
        F.array(
            stars,
            F.when(metric(brightness, 0.5) > 0.65, "☀ Bright"),
            F.when(metric(darkness, 0.5) > 0.65, "🌑 Dark"),
            F.when(metric(blur, 0.0) > 35, "🌫 Blurry"),
            F.when(width.cast("long") * height >= 2073600, "HD High Resolution"),
        )
    )


def is_screenshot(filename: Column, width: Column, height: Column) -> Column:
    name = F.lower(filename)
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    close = F.lit(False)
    for r in vocab.SCREENSHOT_RATIOS:
        close = close | (F.abs(ratio - r) < 0.01)
    exact = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h")).isin(
        *[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in vocab.SCREENSHOT_SIZES]
    )
    by_size = (width > 0) & (height > 0) & (exact | (close & name.endswith(".png")))
    return F.coalesce(
        name.contains("screenshot") | name.contains("scr_") | name.contains("screen_") | by_size,
        F.lit(False),
    )
