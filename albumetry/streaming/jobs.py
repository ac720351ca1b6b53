"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from albumetry import vocab
from albumetry.operators import ingest as N
from albumetry.sources.files import BINARY_SCHEMA, is_image_path


# --- ingest ------------------------------------------------------------------------

def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", True)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).filter(is_image_path(F.col("path")))


def ingest_batch(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Outcome per file of one batch against the catalog so far."""
    return N.mark_copies(N.fingerprint(files), catalog)


PREFIX = 2  # hex digits of the content hash that name a folder of the catalog


def _prefix() -> Column:
    return F.substring("file_hash", 1, PREFIX).alias("prefix")


def known_hashes(spark: SparkSession, catalog_path: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """(file_hash, asset_id) of earlier batches, from the folders of the hashes of this one alone.

    The list of folders has at most 16^PREFIX names; all others are neither listed nor read.
    """
    prefixes = [r["prefix"] for r in batch.filter("is_valid").select(_prefix()).distinct().collect()]
    kind = "file_hash string, asset_id string, prefix string, batch long"
    known = spark.read.schema(kind).option("ignoreMissingFiles", True).parquet(catalog_path)
    return known.filter(F.col("prefix").isin(prefixes) & (F.col("batch") != batch_id)).select("file_hash", "asset_id")


def ingest_stream(prints: DataFrame, catalog_path: str, outcome_path: str, checkpoint: str,
                  after: Callable[[DataFrame, int], None] | None = None, **trigger):
    """A stream of fingerprints (path, filename, file_size, file_hash, is_valid) → deduplicated → catalog.

    The catalog lies in folders by the first digits of the hash and, within, by batch. A micro-batch writes its fingerprints
    once, looks its hashes up in the folders they belong to, and overwrites its own folders, so a batch that is
    retried is written once. ``after`` receives the new assets (for instance for analysis and then quality).
    """
    from albumetry.session import written

    spark = prints.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch)
        marked = written(N.mark_copies(batch, known_hashes(spark, catalog_path, batch, batch_id)))
        marked.write.mode("overwrite").parquet(f"{outcome_path}/batch={batch_id}")
        fresh = written(N.register_assets(marked))
        dealt = fresh.select("*", _prefix(), F.lit(batch_id).cast("long").alias("batch")).repartition("prefix")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(catalog_path)
        if after is not None:
            after(fresh, batch_id)

    # a catalog without a row, so that the first batch has something to look into
    empty = spark.createDataFrame([], "asset_id string, file_hash string, prefix string, batch long")
    empty.write.mode("ignore").partitionBy("prefix", "batch").parquet(catalog_path)
    return (
        prints.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_ingest(spark: SparkSession, source: str, catalog_path: str, outcome_path: str, checkpoint: str,
                  after: Callable[[DataFrame, int], None] | None = None, **trigger):
    """New files → validated, hashed, deduplicated → catalog; see ``ingest_stream``."""
    return ingest_stream(N.fingerprint(file_stream(spark, source)), catalog_path, outcome_path, checkpoint, after, **trigger)


def stream_dedupe(rows: DataFrame, time: str | None = None, delay: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """First row per content hash, of the hashes that the catalog ``known`` (file_hash) does not hold.

    The catalog takes the place of old state: a hash is remembered until ``delay`` has passed, by the event time column, or by
    the time of arrival where there is none, so the state holds the hashes of one delay and not of all time.
    """
    if known is not None:
        rows = rows.join(known.select("file_hash"), "file_hash", "left_anti")
    if time is not None:
        return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["file_hash"])
    timed = rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return timed.dropDuplicatesWithinWatermark(["file_hash"]).drop("_arrived")


# --- asset life cycle -------------------------------------------------------------------
# events: asset_id, seq (order of the event), state, error

def asset_lifecycle(events: DataFrame) -> DataFrame:
    """Batch twin: final status per asset. READY holds until a reset (UPLOADED).

    Aggregates only, so an asset with very many events is combined in parts.
    """
    def latest(state: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("state") == state, F.col("seq"))), F.lit(-1))

    last = F.max(F.struct("seq", "state", "error"))
    done = F.col("ready") > F.col("reset")
    return events.groupBy("asset_id").agg(
        latest("READY").alias("ready"), latest("UPLOADED").alias("reset"), last.alias("last")
    ).select(
        "asset_id",
        F.when(done, "READY").otherwise(F.col("last.state")).alias("status"),
        F.when(~done & (F.col("last.state") == "FAILED"),
               F.substring("last.error", 1, vocab.ASSET_ERROR_CHARS)).alias("error_message"),
    )


def _chunk_last(chunk: pd.DataFrame) -> tuple:
    """(seq, state, error) of the chunk's latest event."""
    row = chunk.loc[chunk["seq"].idxmax()]
    return int(row["seq"]), row["state"], row["error"] if isinstance(row["error"], str) else None


def _latest(chunk: pd.DataFrame, state: str) -> int:
    seq = chunk.loc[chunk["state"] == state, "seq"]
    return int(seq.max()) if len(seq) else -1


class AssetLifecycle(StatefulProcessor):
    """Status per asset; emits a row whenever it changes.

    The state holds maxima by sequence number only, so events may come late and in any order, and very many events of one
    asset are folded chunk by chunk.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "ready long, reset long, seq long, state string, error string", self.ttl_ms)

    @staticmethod
    def _status(ready, reset, seq, state, error):
        if ready > reset:
            return "READY", None
        return state, error[: vocab.ASSET_ERROR_CHARS] if state == "FAILED" and error else None

    def handleInputRows(self, key, rows, timer_values):
        before = tuple(self.state.get()) if self.state.exists() else None
        now = before or (-1, -1, -1, None, None)
        for chunk in rows:
            if len(chunk):
                last = max(now[2:], _chunk_last(chunk), key=lambda x: x[0])
                now = (max(now[0], _latest(chunk, "READY")), max(now[1], _latest(chunk, "UPLOADED")), *last)
        if now != before:
            self.state.update(now)
        if before is None or self._status(*now) != self._status(*before):
            status, error = self._status(*now)
            yield pd.DataFrame({"asset_id": [key[0]], "status": [status], "error_message": [error]})

    def close(self) -> None:
        pass


def stream_asset_lifecycle(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Status changes per asset; with ``ttl_ms`` the state of an asset without events for so long is dropped."""
    id_type = events.schema["asset_id"].dataType.simpleString()
    return events.groupBy("asset_id").transformWithStateInPandas(
        AssetLifecycle(ttl_ms), f"asset_id {id_type}, status string, error_message string", "update",
        "none" if ttl_ms is None else "processingTime",
    )


# --- analysis life cycle ------------------------------------------------------------------

def analysis_lifecycle(events: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Batch twin: last analysis status and how often it failed, READY assets only."""
    if ready is not None:
        events = events.join(ready.select("asset_id"), "asset_id", "left_semi")
    last = F.max(F.struct("seq", "state", "error"))
    failed = F.max(F.when(F.col("state") == "FAILED", F.struct("seq", "error")))
    return events.groupBy("asset_id").agg(
        last.alias("last"), failed.alias("failed"), F.count_if(F.col("state") == "FAILED").alias("retry_count")
    ).select(
        "asset_id", F.col("last.state").alias("status"), "retry_count",
        F.substring("failed.error", 1, vocab.ANALYSIS_ERROR_CHARS).alias("error_message"),
    )


class AnalysisLifecycle(StatefulProcessor):
    """Status, failure count and last error per asset, by sequence number as above."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "seq long, status string, retries long, failed long, error string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        seq, status, retries, failed, error = self.state.get() if self.state.exists() else (-1, "PENDING", 0, -1, None)
        for chunk in rows:
            if not len(chunk):
                continue
            last = _chunk_last(chunk)
            if last[0] > seq:
                seq, status = last[:2]
            wrong = chunk[chunk["state"] == "FAILED"]
            retries += len(wrong)
            if len(wrong) and _chunk_last(wrong)[0] > failed:
                failed, _, text = _chunk_last(wrong)
                error = text[: vocab.ANALYSIS_ERROR_CHARS] if text else None
        self.state.update((seq, status, retries, failed, error))
        yield pd.DataFrame({"asset_id": [key[0]], "status": [status], "retry_count": [retries], "error_message": [error]})

    def close(self) -> None:
        pass


def stream_analysis_lifecycle(events: DataFrame, ready: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Analysis status per asset; with ``ready`` (a table of asset_id) only events of READY assets count."""
    if ready is not None:
        events = events.join(ready.select("asset_id").distinct(), "asset_id", "left_semi")
    id_type = events.schema["asset_id"].dataType.simpleString()
    return events.groupBy("asset_id").transformWithStateInPandas(
        AnalysisLifecycle(ttl_ms),
        f"asset_id {id_type}, status string, retry_count long, error_message string", "update",
        "none" if ttl_ms is None else "processingTime",
    )


STEPS = ("records", "quality")


def analysis_then_quality(analyse: Callable[[DataFrame], DataFrame], assess: Callable[[DataFrame], DataFrame],
                          record_path: str, quality_path: str, commit_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: quality follows analysis, whether that succeeded or not.

    Each of both writes of a batch is followed by a commit record (batch, step) below ``commit_path`` (where not given,
    beside the records). A batch that is retried after a failure in between goes on after its last commit: what was analysed
    is not analysed again, as a model may answer otherwise. ``committed`` reads whole batches alone.
    """
    commits = commit_path or f"{record_path.rstrip('/')}_commits"

    def step(assets: DataFrame, batch_id: int) -> None:
        spark = assets.sparkSession
        done = {r["step"] for r in _commits(spark, commits).filter(F.col("batch") == batch_id).collect()}  # two rows at most
        for name, make, path in zip(STEPS, (analyse, assess), (record_path, quality_path)):
            if name not in done:
                make(assets).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
                record = spark.createDataFrame([(batch_id, name)], "number long, name string").coalesce(1)
                record.write.mode("overwrite").parquet(f"{commits}/batch={batch_id}/step={name}")

    return step


def _commits(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], "number long, name string").write.mode("ignore").parquet(f"{path}/batch=-1/step=none")
    rows = spark.read.schema("number long, name string, batch long, step string").parquet(path)
    return rows.select("batch", "step").filter(F.col("step").isin(*STEPS)).distinct()


def committed(spark: SparkSession, path: str, commit_path: str) -> DataFrame:
    """Rows of the batches below ``path`` of which both steps are committed."""
    whole = _commits(spark, commit_path).groupBy("batch").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(STEPS)).select("batch")
    return spark.read.parquet(path).join(whole, "batch", "left_semi").drop("batch")
