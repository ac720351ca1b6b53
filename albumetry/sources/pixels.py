"""Pixel statistics and perceptual hashes of decoded images.

The only built-in Python step: one Arrow UDF reads the image bytes once and
returns every pixel field. Scores, labels and names are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetry.functions import hashes as H
from albumetry.functions import quality as Q

PIXEL_FIELDS = (
    "brightness double, sharpness double, edge_stddev_cropped double, mean_r int, mean_g int, mean_b int, "
    "grid64 array<double>, grid72 array<double>"
)


def _area_mean(grey: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of each cell of a rows × cols raster over the image."""
    h, w = grey.shape
    r = (np.arange(rows + 1) * h) // rows
    c = (np.arange(cols + 1) * w) // cols
    out = np.empty((rows, cols))
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = grey.cumsum(0).cumsum(1)
    for i in range(rows):
        top, bottom = r[i], max(r[i + 1], r[i] + 1)
        for j in range(cols):
            left, right = c[j], max(c[j + 1], c[j] + 1)
            total = sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]
            out[i, j] = total / ((bottom - top) * (right - left))
    return out


def _edges(grey: np.ndarray) -> np.ndarray:
    """3×3 edge filter (centre 8, neighbours -1) clipped to 0-255; border kept."""
    out = grey.copy()
    if min(grey.shape) < 3:
        return out
    s = sum(
        grey[1 + dy: grey.shape[0] - 1 + dy, 1 + dx: grey.shape[1] - 1 + dx]
        for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx
    )
    out[1:-1, 1:-1] = np.clip(8 * grey[1:-1, 1:-1] - s, 0, 255)
    return out


def pixel_row(width: int, height: int, channels: int, data: bytes) -> tuple | None:
    """All pixel fields of one decoded image; null for undecodable ones."""
    if width <= 0 or height <= 0 or not data:
        return (None,) * 8
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    bgr = a[:, :, :3].astype(np.float64) if channels >= 3 else np.repeat(a[:, :, :1], 3, axis=2).astype(np.float64)
    grey = np.floor(bgr[:, :, 2] * 0.299 + bgr[:, :, 1] * 0.587 + bgr[:, :, 0] * 0.114 + 0.5)
    edges = _edges(grey)
    m = min(2, width // 4, height // 4)
    inner = edges[m: height - m, m: width - m] if m > 0 else edges
    b, g, r = (int(x) for x in bgr.reshape(-1, 3).mean(axis=0))
    return (
        float(grey.mean() / 255.0), float(edges.std()), float(inner.std()), r, g, b,
        _area_mean(grey, 8, 8).ravel().tolist(), _area_mean(grey, 8, 9).ravel().tolist(),
    )


def _pixel_fields(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = [pixel_row(*r) for r in zip(width, height, channels, data)]
    names = [f.strip().split(" ")[0] for f in PIXEL_FIELDS.split(", ")]
    return pd.DataFrame(rows, columns=names)


def pixel_metrics(pixels: DataFrame) -> DataFrame:
    """Per image path: size, metrics with defaults, both hashes, colours, screenshot flag.

    Bytes do not leave this step. Undecodable images keep default metrics and
    null hashes. Keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` low
    (for example 64), as rows hold whole images.
    """
    read = F.pandas_udf(_pixel_fields, PIXEL_FIELDS)
    out = pixels.withColumn("p", read("width", "height", "channels", "data")).drop("data")
    out = out.select("path", "width", "height", "channels", "p.*")
    good = F.col("brightness").isNotNull()
    raw = F.col("sharpness")
    name = F.element_at(F.split("path", "/"), -1)
    return out.select(
        "path", "width", "height", good.alias("decoded"),
        F.coalesce(F.round("brightness", 4), F.lit(0.5)).alias("brightness"),
        F.coalesce(F.round(1.0 - F.col("brightness"), 4), F.lit(0.5)).alias("darkness"),
        F.coalesce(F.round(Q.blur_score(raw), 4), F.lit(50.0)).alias("blur_score"),
        F.coalesce(F.round(raw, 4), F.lit(10.0)).alias("sharpness"),
        F.round("edge_stddev_cropped", 4).alias("edge_stddev_cropped"),
        F.when(good, Q.is_screenshot(name, F.col("width"), F.col("height"))).otherwise(False).alias("is_screenshot"),
        F.when(good, H.ahash64(F.col("grid64"))).alias("ahash"),
        F.when(good, H.dhash64(F.col("grid72"))).alias("dhash"),
        F.when(good, H.dominant_colours(F.col("mean_r"), F.col("mean_g"), F.col("mean_b")))
        .otherwise(F.array(F.lit("gray"))).alias("colours"),
    )
