"""Library queries and recycle bin; changes are returned as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.operators.scale import page_of


def active(assets: DataFrame) -> DataFrame:
    return assets.filter(~F.col("is_deleted"))


def hydrate(assets: DataFrame, metadata: DataFrame | None = None, records: DataFrame | None = None,
            quality: DataFrame | None = None) -> DataFrame:
    """Assets with their one-to-one children; missing children give nulls."""
    out = assets
    for child in (metadata, records, quality):
        if child is not None:
            out = out.join(child, "asset_id", "left")
    return out


def list_active(assets: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Active assets, newest first; of a page (``limit``) only the slice that holds it is sorted."""
    if limit is None:
        return active(assets).orderBy(F.col("created_at").desc(), "asset_id").offset(offset)
    return page_of(active(assets), -F.unix_micros("created_at"), [F.col("asset_id")], offset, limit)


GALLERY_ORDERS: dict[str, list] = {
    "newest": [("created_at", False), ("asset_id", True)],
    "oldest": [("created_at", True), ("asset_id", True)],
    "largest": [("file_size", False), ("asset_id", True)],
    "name": [("lower(filename)", True), ("filename", True), ("asset_id", True)],
}


def gallery(assets: DataFrame, status: str = "ALL", order: str = "newest") -> DataFrame:
    """Active assets of one status in one of four orders."""
    out = active(assets)
    if status != "ALL":
        out = out.filter(F.col("status") == status)
    return out.orderBy(*[F.expr(e).asc() if up else F.expr(e).desc() for e, up in GALLERY_ORDERS[order]])


def asset_detail(ids: DataFrame, assets: DataFrame, metadata: DataFrame, records: DataFrame, quality: DataFrame) -> DataFrame:
    return hydrate(assets.join(ids, "asset_id", "left_semi"), metadata, records, quality)


def asset_status(assets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Status and error of a set of ids (or all)."""
    rows = assets if ids is None else assets.join(ids, "asset_id", "left_semi")
    return rows.select("asset_id", "status", "error_message")


def status_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("status").agg(F.count("*").alias("assets"))


# --- recycle bin ---------------------------------------------------------------------

def _marked(assets: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = ids.select("asset_id", F.lit(True).alias("_chosen")).distinct()
    return assets.join(chosen, "asset_id", "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))


def soft_delete(assets: DataFrame, ids: DataFrame, deleted_from: str | None = None, now: Column | None = None) -> DataFrame:
    """Marks the ids as deleted; vectors and children stay."""
    hit = F.col("_chosen")
    when = F.current_timestamp() if now is None else now
    return _marked(assets, ids).withColumns(
        {
            "is_deleted": F.col("is_deleted") | hit,
            "deleted_at": F.when(hit, when).otherwise(F.col("deleted_at")),
            "deleted_from": F.when(hit, F.lit(deleted_from)).otherwise(F.col("deleted_from")),
        }
    ).drop("_chosen")


def restore(assets: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("_chosen")
    return _marked(assets, ids).withColumns(
        {
            "is_deleted": F.col("is_deleted") & ~hit,
            "deleted_at": F.when(~hit, F.col("deleted_at")),
            "deleted_from": F.when(~hit, F.col("deleted_from")),
        }
    ).drop("_chosen")


def restored_count(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids found in the catalog; an active one counts too."""
    return assets.join(ids, "asset_id", "left_semi").agg(F.count("*").alias("restored"))


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the ids (parent, children and vectors)."""
    return {name: t.join(ids.select("asset_id"), "asset_id", "left_anti") for name, t in tables.items()}


def expired_trash(assets: DataFrame, now: Column | None = None, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """Deleted at least ``days`` ago."""
    when = F.current_timestamp() if now is None else now
    cutoff = when - F.make_interval(days=F.lit(days))
    return assets.filter(F.col("is_deleted") & (F.col("deleted_at") <= cutoff))


def remaining_days(deleted_at: Column, now: Column, days: int = vocab.RETENTION_DAYS) -> Column:
    passed = F.floor((F.unix_micros(now) - F.unix_micros(deleted_at)) / 86_400_000_000)
    left = F.lit(days) - passed
    return F.coalesce(F.when(left > 0, left).when(left <= 0, 0), F.lit(days)).cast("int")


def trash_list(assets: DataFrame, now: Column | None = None, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """The bin after expired items are gone, latest deletion first."""
    when = F.current_timestamp() if now is None else now
    kept = F.col("is_deleted") & ~F.coalesce(
        F.col("deleted_at") <= when - F.make_interval(days=F.lit(days)), F.lit(False)
    )
    return (
        assets.filter(kept)
        .withColumn("remaining_days", remaining_days(F.col("deleted_at"), when, days))
        .orderBy(F.col("deleted_at").desc(), "asset_id")
    )


def trash_totals(assets: DataFrame) -> DataFrame:
    return assets.filter("is_deleted").agg(
        F.count("*").alias("trash_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("trash_bytes")
    )


def empty_trash(tables: dict[str, DataFrame], assets: DataFrame) -> dict[str, DataFrame]:
    return purge(tables, assets.filter("is_deleted"))


def without_kept(assets: DataFrame, kept: DataFrame) -> DataFrame:
    """Hides items the user chose to keep."""
    return assets.join(kept.select("asset_id"), "asset_id", "left_anti")


def kept_after_restore(kept: DataFrame, restored: DataFrame) -> DataFrame:
    return kept.join(restored.select("asset_id"), "asset_id", "left_anti")


# --- work lists --------------------------------------------------------------------------

def reset_for_reprocess(assets: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents back to UPLOADED, children (metadata, vectors register, quality) dropped."""
    hit = F.col("_chosen")
    changed = {"status": F.when(hit, "UPLOADED").otherwise(F.col("status"))}
    for c in ("thumbnail_path", "error_message"):
        if c in assets.columns:
            changed[c] = F.when(~hit, F.col(c))
    if "updated_at" in assets.columns:
        changed["updated_at"] = F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))
    return _marked(assets, ids).withColumns(changed).drop("_chosen"), purge(children, ids)


def missing_quality(assets: DataFrame, quality: DataFrame) -> DataFrame:
    return assets.join(quality.select("asset_id"), "asset_id", "left_anti")


def backfill_totals(work: DataFrame, done: DataFrame) -> DataFrame:
    """How many of the work list got a row."""
    hit = work.select("asset_id").join(done.select("asset_id", F.lit(1).alias("ok")).distinct(), "asset_id", "left")
    return hit.agg(
        F.count("*").alias("total_unprocessed"), F.count("ok").alias("success"),
        F.count_if(F.col("ok").isNull()).alias("failed"),
    )


def rebuild_worklist(assets: DataFrame, limit: int | None = None) -> DataFrame:
    """READY assets, oldest id first; all of them, or ``limit`` per run if the caller gives one."""
    ready = assets.filter(F.col("status") == "READY").orderBy("asset_id")
    return ready if limit is None else ready.limit(limit)
