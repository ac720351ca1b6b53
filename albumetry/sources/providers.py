"""User-supplied models as table steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetry import vocab


def run_vision_provider(assets: DataFrame, analyze: Callable, prompt: str = "prompt", path: str = "original_path") -> DataFrame:
    """Runs a pandas UDF over READY assets and sets the analysis status.

    ``analyze(path, prompt)`` maps two series to a frame (response, error), as a plain function or a pandas UDF: no
    response and no error means no provider (skipped), an error text means failed. If it raises, the rows of the batch
    are tried one by one, and those that raise again fail with the exception's text.
    """
    step = getattr(analyze, "func", analyze)

    @F.pandas_udf("response string, error string")
    def careful(paths: pd.Series, prompts: pd.Series) -> pd.DataFrame:
        try:
            return step(paths, prompts)
        except Exception:
            parts = []
            for k in range(len(paths)):
                try:
                    parts.append(step(paths.iloc[k: k + 1].reset_index(drop=True), prompts.iloc[k: k + 1].reset_index(drop=True)))
                except Exception as error:
                    parts.append(pd.DataFrame({"response": [None], "error": [str(error) or type(error).__name__]}))
            return pd.concat(parts, ignore_index=True)

    ready = assets.filter(F.col("status") == "READY")
    called = ready.withColumn("_r", careful(F.col(path), F.col(prompt)))
    error = F.col("_r.error")
    status = F.when(error.isNotNull(), "FAILED").when(F.col("_r.response").isNull(), "SKIPPED_NO_PROVIDER").otherwise("COMPLETED")
    return called.select(
        "asset_id",
        F.when(error.isNull(), F.col("_r.response")).alias("response"),
        status.alias("processing_status"),
        F.substring(error, 1, vocab.ANALYSIS_ERROR_CHARS).alias("error_message"),
        F.when(error.isNotNull(), 1).otherwise(0).alias("failures"),
        F.current_timestamp().alias("processed_at"),
    )


def run_quality_provider(assets: DataFrame, evaluate: Callable, name: str, columns: list[str]) -> DataFrame:
    """Runs a pandas UDF returning struct<sharpness, exposure, aesthetic, resolution,
    confidence, brightness, blur_score>; a null result means unavailable."""
    called = assets.withColumn("_r", evaluate(*[F.col(c) for c in columns]))
    fields = ["sharpness", "exposure", "aesthetic", "resolution"]
    return called.select(
        "asset_id", F.lit(name).alias("provider"), F.col("_r").isNotNull().alias("is_available"),
        *[F.col(f"_r.{f}").alias(f) for f in fields],
        F.coalesce(F.col("_r.confidence"), F.lit(0.0)).alias("confidence"),
        F.col("_r.brightness").alias("brightness"), F.col("_r.blur_score").alias("blur_score"),
    )
