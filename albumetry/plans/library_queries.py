"""Library queries, recycle bin, ingest, quality and knowledge records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import hashes as H
from albumetry.functions import quality as QF
from albumetry.functions import records as RF
from albumetry.functions import text as X
from albumetry.operators import catalog as C
from albumetry.operators import ingest as N
from albumetry.operators import quality as Q
from albumetry.operators import records as R
from albumetry.operators.stored import StoredTable, purge_stored, reset_stored
from albumetry.plans import views as W
from albumetry.plans.registry import epoch, joined, query
from albumetry.plans.sql import NOW, any_in, exact_round, grid, one_of, strip, texts, with_views
from albumetry.session import scratch_dir
from albumetry.sources.files import category_counts

US = "epoch_us"


# --- library -------------------------------------------------------------------------

@query("list_active", with_views(f"""SELECT asset_id, filename, {US}(created_at) AS created_at FROM assets WHERE NOT is_deleted
    ORDER BY created_at DESC, asset_id LIMIT 100 OFFSET 20""", "assets"))
def list_active(spark, sf):
    return C.list_active(W.assets(spark, sf), 100, 20).select("asset_id", "filename", epoch("created_at"))


@query("gallery_sorted", with_views("SELECT asset_id, filename, file_size FROM assets WHERE NOT is_deleted AND status = 'READY'", "assets"))
def gallery_sorted(spark, sf):
    return C.gallery(W.assets(spark, sf), "READY", "largest").select("asset_id", "filename", "file_size")


@query("gallery_by_name", with_views("SELECT asset_id, filename, status FROM assets WHERE NOT is_deleted", "assets"))
def gallery_by_name(spark, sf):
    return C.gallery(W.assets(spark, sf), "ALL", "name").select("asset_id", "filename", "status")


@query("hydrate", with_views("""SELECT a.asset_id, filename, width, scene, people_count, quality_grade FROM assets a
    LEFT JOIN records r ON r.asset_id = a.asset_id LEFT JOIN quality q ON q.asset_id = a.asset_id""", "assets", "records", "quality"))
def hydrate(spark, sf):
    out = C.hydrate(W.assets(spark, sf), None, W.records(spark, sf), W.quality(spark, sf))
    return out.select("asset_id", "filename", F.col("width").cast("long").alias("width"), "scene", F.col("people_count").cast("long").alias("people_count"), "quality_grade")


@query("asset_detail", with_views(f"""SELECT a.asset_id, filename, status, caption, quality_grade, {exact_round("overall", 4)} AS overall_score FROM assets a
    JOIN records r ON r.asset_id = a.asset_id LEFT JOIN quality q ON q.asset_id = a.asset_id
    WHERE a.asset_id IN (SELECT item_id FROM benchmark)""", "assets", "records", "quality"))
def asset_detail(spark, sf):
    wanted = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("asset_id"))
    meta = W.pixel_metrics(spark, sf).select("asset_id", "brightness")
    out = C.asset_detail(wanted, W.assets(spark, sf), meta, W.records(spark, sf), W.quality(spark, sf))
    return out.select("asset_id", "filename", "status", "caption", "quality_grade", "overall_score")


@query("asset_status", with_views("""SELECT asset_id, status, CASE WHEN status = 'FAILED' THEN 'bad ' || filename END AS error_message
    FROM assets WHERE asset_id IN (SELECT page_id FROM pages)""", "assets"))
def asset_status(spark, sf):
    a = W.assets(spark, sf).withColumn("error_message", F.when(F.col("status") == "FAILED", F.concat(F.lit("bad "), "filename")))
    return C.asset_status(a, W.table(spark, sf, "pages").select(F.col("page_id").alias("asset_id")))


@query("status_counts", with_views("SELECT status, count(*) AS assets FROM assets GROUP BY status", "assets"))
def status_counts(spark, sf):
    return C.status_counts(W.assets(spark, sf))


def _bin(df):
    return df.select("asset_id", "is_deleted", epoch("deleted_at"), "deleted_from")


LOW = "(SELECT doc_id FROM labels WHERE quality = 0)"


def _low(spark, sf):
    return W.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("asset_id"))


@query("soft_delete", with_views(f"""SELECT asset_id, is_deleted OR asset_id IN {LOW} AS is_deleted,
    {US}(CASE WHEN asset_id IN {LOW} THEN {NOW} ELSE deleted_at END) AS deleted_at,
    CASE WHEN asset_id IN {LOW} THEN 'gallery' ELSE deleted_from END AS deleted_from FROM assets""", "assets"))
def soft_delete(spark, sf):
    return _bin(C.soft_delete(W.assets(spark, sf), _low(spark, sf), "gallery", W.at(W.NOW)))


@query("restore", with_views(f"""SELECT asset_id, is_deleted AND asset_id NOT IN {LOW} AS is_deleted,
    {US}(CASE WHEN asset_id NOT IN {LOW} THEN deleted_at END) AS deleted_at,
    CASE WHEN asset_id NOT IN {LOW} THEN deleted_from END AS deleted_from FROM assets""", "assets"))
def restore(spark, sf):
    return _bin(C.restore(W.assets(spark, sf), _low(spark, sf)))


@query("restored_count", with_views(f"SELECT count(*) AS restored FROM assets WHERE asset_id IN {LOW}", "assets"))
def restored_count(spark, sf):
    return C.restored_count(W.assets(spark, sf), _low(spark, sf))


def _tables(spark, sf):
    return {
        "assets": W.assets(spark, sf).select("asset_id"),
        "records": W.table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id")),
        "vectors": W.vectors(spark, sf).select("asset_id"),
        "quality": W.table(spark, sf, "labels").select(F.col("doc_id").alias("asset_id")),
    }


def _left(tables):
    out = None
    for name, t in tables.items():
        one = t.select(F.lit(name).alias("name"), "asset_id")
        out = one if out is None else out.unionByName(one)
    return out


def _purged(condition: str) -> str:
    return with_views(f"""SELECT 'assets' AS name, asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM gone)
        UNION ALL SELECT 'records', doc_id FROM documents WHERE doc_id NOT IN (SELECT asset_id FROM gone)
        UNION ALL SELECT 'vectors', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT asset_id FROM gone)
        UNION ALL SELECT 'quality', doc_id FROM labels WHERE doc_id NOT IN (SELECT asset_id FROM gone)""",
                      "assets", gone=f"SELECT asset_id FROM assets WHERE {condition}")


@query("purge", _purged(f"is_deleted AND deleted_at <= {NOW} - INTERVAL 30 DAY"))
def purge(spark, sf):
    """Expired rows leave every table."""
    return _left(C.purge(_tables(spark, sf), C.expired_trash(W.assets(spark, sf), W.at(W.NOW))))


@query("empty_trash", _purged("is_deleted"))
def empty_trash(spark, sf):
    return _left(C.empty_trash(_tables(spark, sf), W.assets(spark, sf)))


def _stored(spark, tables, key="asset_id", buckets=32):
    """The tables, stored in buckets."""
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    return {name: StoredTable(spark, f"{out}/{name}", key, buckets).create(t) for name, t in tables.items()}


@query("stored_purge", _purged(f"is_deleted AND deleted_at <= {NOW} - INTERVAL 30 DAY"))
def stored_purge(spark, sf):
    """Expired rows leave every stored table, bucket by bucket."""
    stored = _stored(spark, _tables(spark, sf))
    purge_stored(stored, C.expired_trash(W.assets(spark, sf), W.at(W.NOW)))
    return _left({name: t.read() for name, t in stored.items()})


@query("stored_reset", with_views(f"""SELECT 'asset' AS name, asset_id, CASE WHEN asset_id IN {LOW} THEN 'UPLOADED' ELSE status END AS status FROM assets
    UNION ALL SELECT 'quality', doc_id, NULL FROM labels WHERE doc_id NOT IN {LOW}
    UNION ALL SELECT 'vectors', vec_id, NULL FROM embeddings WHERE vec_id NOT IN {LOW}""", "assets"))
def stored_reset(spark, sf):
    t = _tables(spark, sf)
    stored = _stored(spark, {"asset": W.assets(spark, sf).select("asset_id", "status"), "quality": t["quality"], "vectors": t["vectors"]})
    reset_stored(stored["asset"], {"quality": stored["quality"], "vectors": stored["vectors"]}, _low(spark, sf))
    top = stored["asset"].read().select(F.lit("asset").alias("name"), "asset_id", "status")
    rest = _left({name: stored[name].read() for name in ("quality", "vectors")})
    return top.unionByName(rest.withColumn("status", F.lit(None).cast("string")))


@query("expired_trash", with_views(f"""SELECT asset_id, {US}(deleted_at) AS deleted_at FROM assets
    WHERE is_deleted AND deleted_at <= {NOW} - INTERVAL 30 DAY""", "assets"))
def expired_trash(spark, sf):
    return C.expired_trash(W.assets(spark, sf), W.at(W.NOW)).select("asset_id", epoch("deleted_at"))


@query("trash_list", with_views(f"""SELECT asset_id, greatest(0, 30 - CAST(floor((epoch_us({NOW}) - epoch_us(deleted_at)) / 86400000000) AS INT)) AS remaining_days
    FROM assets WHERE is_deleted AND deleted_at > {NOW} - INTERVAL 30 DAY""", "assets"))
def trash_list(spark, sf):
    return C.trash_list(W.assets(spark, sf), W.at(W.NOW)).select("asset_id", "remaining_days")


@query("trash_totals", with_views("SELECT count(*) AS trash_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS trash_bytes FROM assets WHERE is_deleted", "assets"))
def trash_totals(spark, sf):
    return C.trash_totals(W.assets(spark, sf))


@query("without_kept", with_views("SELECT asset_id, filename FROM assets WHERE NOT is_deleted AND asset_id NOT IN (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels))", "assets"))
def without_kept(spark, sf):
    kept = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("asset_id"))
    kept = C.kept_after_restore(kept, W.table(spark, sf, "labels").select(F.col("doc_id").alias("asset_id")))
    return C.without_kept(C.active(W.assets(spark, sf)), kept).select("asset_id", "filename")


@query("reset_for_reprocess", with_views(f"""SELECT 'asset' AS name, asset_id, CASE WHEN asset_id IN {LOW} THEN 'UPLOADED' ELSE status END AS status FROM assets
    UNION ALL SELECT 'quality', doc_id, NULL FROM labels WHERE doc_id NOT IN {LOW}
    UNION ALL SELECT 'vectors', vec_id, NULL FROM embeddings WHERE vec_id NOT IN {LOW}""", "assets"))
def reset_for_reprocess(spark, sf):
    t = _tables(spark, sf)
    parent, children = C.reset_for_reprocess(W.assets(spark, sf), {"quality": t["quality"], "vectors": t["vectors"]}, _low(spark, sf))
    top = parent.select(F.lit("asset").alias("name"), "asset_id", "status")
    return top.unionByName(_left(children).withColumn("status", F.lit(None).cast("string")))


@query("missing_quality", with_views("SELECT asset_id, filename FROM assets WHERE asset_id NOT IN (SELECT doc_id FROM labels)", "assets"))
def missing_quality(spark, sf):
    return C.missing_quality(W.assets(spark, sf), _tables(spark, sf)["quality"]).select("asset_id", "filename")


@query("backfill_totals", """SELECT count(*) AS total_unprocessed, count(vec_id) AS success, count(*) - count(vec_id) AS failed
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def backfill_totals(spark, sf):
    t = _tables(spark, sf)
    return C.backfill_totals(C.missing_quality(t["assets"], t["quality"]), t["vectors"])


@query("rebuild_worklist", with_views("SELECT asset_id FROM assets WHERE status = 'READY'", "assets"))
def rebuild_worklist(spark, sf):
    return C.rebuild_worklist(W.assets(spark, sf)).select("asset_id")


# --- ingest ------------------------------------------------------------------------------

def _batch(spark, sf):
    """Documents as uploaded files; empty detected pages stand for broken ones."""
    a = W.assets(spark, sf, content_hash=True)
    return a.select(
        F.concat(F.lit("/in/"), F.lpad(F.col("asset_id").cast("string"), 12, "0"), F.lit("/"), "filename").alias("path"),
        "filename", "file_size", "file_hash", (~F.col("filename").endswith(".mp4")).alias("is_valid"),
    )


def _known(spark, sf):
    """Catalog: the labelled documents, one row per hash."""
    a = W.assets(spark, sf, content_hash=True).join(_tables(spark, sf)["quality"], "asset_id", "left_semi")
    return a.groupBy("file_hash").agg(F.min("asset_id").alias("asset_id"))


BATCH = """
    SELECT '/in/' || lpad(CAST(asset_id AS VARCHAR), 12, '0') || '/' || filename AS path, filename, file_hash, file_size,
        NOT ends_with(filename, '.mp4') AS is_valid FROM assets"""
KNOWN = "SELECT file_hash, min(asset_id) AS existing_id FROM assets WHERE asset_id IN (SELECT doc_id FROM labels) GROUP BY file_hash"
MARKED = """
    SELECT b.*, existing_id, CASE WHEN existing_id IS NOT NULL THEN 'skipped'
        WHEN row_number() OVER (PARTITION BY b.file_hash ORDER BY path) = 1 THEN 'new' ELSE 'skipped' END AS outcome
    FROM batch b LEFT JOIN known k ON k.file_hash = b.file_hash WHERE is_valid
    UNION ALL SELECT b.*, NULL, 'failed' FROM batch b WHERE NOT is_valid"""


def _ingest(body: str) -> str:
    return with_views(body, "assets", batch=BATCH, known=KNOWN, marked=MARKED)


@query("mark_copies", _ingest("SELECT path, file_hash, existing_id, outcome FROM marked"))
def mark_copies(spark, sf):
    return N.mark_copies(_batch(spark, sf), _known(spark, sf)).select("path", "file_hash", "existing_id", "outcome")


@query("stream_ingest", with_views("""SELECT path, file_hash, CASE WHEN NOT is_valid THEN 'failed'
        WHEN row_number() OVER (PARTITION BY file_hash, is_valid ORDER BY path) = 1 THEN 'new' ELSE 'skipped' END AS outcome FROM batch""", "assets", batch=BATCH))
def stream_ingest(spark, sf):
    """All documents as a stream of uploads into an empty catalog."""
    from albumetry.streaming import jobs as J

    cols, schema = W.asset_columns(), W.table(spark, sf, "documents").schema
    # as a pattern: a stream's path must else be a folder
    d = spark.readStream.schema(schema).parquet(f"{sf}/[d]ocuments.parquet")
    d = d.select(*[cols[c].alias(c) for c in ("asset_id", "filename", "file_size")], F.sha2("text", 256).alias("file_hash"))
    prints = d.select(
        F.concat(F.lit("/in/"), F.lpad(F.col("asset_id").cast("string"), 12, "0"), F.lit("/"), "filename").alias("path"),
        "filename", F.col("file_size").cast("long").alias("file_size"), "file_hash", (~F.col("filename").endswith(".mp4")).alias("is_valid"))
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    J.ingest_stream(prints, f"{out}/catalog", f"{out}/outcome", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/outcome").select("path", "file_hash", "outcome")


@query("split_duplicates", _ingest("SELECT path, existing_id FROM marked WHERE existing_id IS NOT NULL"))
def split_duplicates(spark, sf):
    return N.conflicts(N.mark_copies(_batch(spark, sf), _known(spark, sf))).select("path", "existing_id")


@query("register_assets", _ingest(f"""SELECT substr(file_hash, 1, 8) || '-' || substr(file_hash, 9, 4) || '-' || substr(file_hash, 13, 4) || '-' || substr(file_hash, 17, 4) || '-' || substr(file_hash, 21, 12) AS asset_id,
    filename, 'image/' || replace(regexp_extract(filename, '\\.([^.]*)$', 1), 'jpg', 'jpeg') AS mime_type, 'PHOTO' AS media_type, file_size, 'UPLOADED' AS status, {US}({NOW}) AS created_at FROM marked WHERE outcome = 'new'"""))
def register_assets(spark, sf):
    out = N.register_assets(N.mark_copies(_batch(spark, sf), _known(spark, sf)), W.at(W.NOW))
    return out.select("asset_id", "filename", "mime_type", "media_type", "file_size", "status", epoch("created_at"))


@query("manifest", _ingest("""SELECT count(*) AS total_images, count(*) FILTER (outcome = 'new') AS imported,
    count(*) FILTER (outcome = 'skipped') AS duplicates_skipped, count(*) FILTER (outcome = 'failed') AS failed FROM marked"""))
def manifest(spark, sf):
    return N.ingest_summary(N.mark_copies(_batch(spark, sf), _known(spark, sf)))


@query("directory_manifest", with_views("SELECT lang AS category, count(*) AS count FROM documents GROUP BY lang"))
def directory_manifest(spark, sf):
    d = W.table(spark, sf, "documents")
    return category_counts(d.select(F.concat(F.lit("/pics/"), "lang", F.lit("/"), "source").alias("path")))


@query("signature", """
SELECT doc_id, sha256(text) AS file_hash, starts_with(lang, 'f') AND strlen(text) > 0 AS is_valid FROM documents""")
def signature(spark, sf):
    """French texts get a JPEG mark in front before the signature check."""
    d = W.table(spark, sf, "documents")
    body = F.encode("text", "UTF-8")
    marked = F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("FFD8FFE0")), body)).otherwise(body)
    return d.select("doc_id", F.sha2(body, 256).alias("file_hash"), H.valid_signature(marked).alias("is_valid"))


def _tags(spark, sf):
    """Raw tags: shop items as cameras, every third without base values."""
    p = W.table(spark, sf, "part")
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    bare = key % 3 == 0
    rows = [
        ("base", "Make", F.concat(F.lit(" "), "p_brand", F.lit(" "))), ("base", "Model", F.col("p_name")),
        ("base", "FNumber", F.when(~bare, F.when(key % 5 == 0, F.col("p_type")).otherwise((F.col("p_size") / 4).cast("string")))),
        ("exif", "FNumber", (F.col("p_size") / 8).cast("string")),
        ("base", "ISOSpeedRatings", F.when(~bare, F.concat((F.col("p_size") * 100).cast("string"), F.lit(",200")))),
        ("exif", "ISOSpeedRatings", F.lit("64")),
        ("base", "DateTimeOriginal", F.when(~bare, F.lit("not a date"))),
        ("exif", "DateTimeOriginal", F.concat(F.lit("2023:05:"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:20:30"))),
        ("base", "GPSLatitude", F.when(~bare, F.concat_ws(",", (key % 90).cast("string"), F.lit("30"), F.lit("36")))),
        ("base", "GPSLatitudeRef", F.when(key % 2 == 0, "S").otherwise("N")),
        ("gps", "GPSLatitude", F.lit("10,15,0")), ("gps", "GPSLatitudeRef", F.lit("s")),
        ("gps", "GPSLongitude", F.lit("20,bad,0")), ("gps", "GPSLongitudeRef", F.lit("W")),
        ("base", "GPSLongitude", F.lit("5,0,36")), ("base", "GPSLongitudeRef", F.lit("W")),
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("ifd"), F.lit(t).alias("tag"), v.alias("value")) for i, t, v in rows])
    return p.select(key.alias("asset_id"), F.explode(listed).alias("t")).select("asset_id", "t.*").filter("value is not null")


@query("normalise_exif", f"""
SELECT p_partkey AS asset_id, p_brand AS camera_make, p_name AS camera_model,
    CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 3 <> 0 THEN printf('f/%.2f', p_size / 4) ELSE printf('f/%.2f', p_size / 8) END AS f_number,
    CASE WHEN p_partkey % 3 <> 0 THEN p_size * 100 ELSE 64 END AS iso_speed,
    {US}(strptime('2023:05:' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || ' 10:20:30', '%Y:%m:%d %H:%M:%S')) AS taken_at,
    round(CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 90 + 0.51) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END ELSE -10.25 END, 6)::DOUBLE AS gps_latitude,
    -5.01::DOUBLE AS gps_longitude
FROM part""")
def normalise_exif(spark, sf):
    out = N.normalise_exif(_tags(spark, sf))
    return out.select("asset_id", "camera_make", "camera_model", "f_number", F.col("iso_speed").cast("long").alias("iso_speed"),
                      epoch("taken_at"), F.round("gps_latitude", 6).alias("gps_latitude"), F.round("gps_longitude", 6).alias("gps_longitude"))


@query("migrate_paths", """
SELECT page_id AS asset_id, CASE WHEN contains(url, 'example.com') THEN '/storage/' || ltrim(replace(lower(url), chr(92), '/'), '/') ELSE '/mnt/' || url END AS original_path FROM pages""")
def migrate_paths(spark, sf):
    p = W.table(spark, sf, "pages")
    host = F.concat(F.lit("C:\\Data\\STORAGE\\"), "url")
    a = p.select(F.col("page_id").alias("asset_id"),
                 F.when(F.contains("url", F.lit("example.com")), host).otherwise(F.concat(F.lit("/mnt/"), "url")).alias("original_path"),
                 F.lit(None).cast("string").alias("thumbnail_path"))
    return N.migrate_paths(a).select("asset_id", "original_path")


@query("effective_taken_at", with_views(f"SELECT asset_id, {US}(coalesce(ts, taken_at)) AS taken_at FROM assets LEFT JOIN (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id) ON user_id = asset_id", "assets"))
def effective_taken_at(spark, sf):
    meta = W.table(spark, sf, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.min("ts").cast("timestamp").alias("taken_at"))
    return N.effective_taken_at(W.assets(spark, sf), meta).select("asset_id", epoch("taken_at"))


@query("ingest_caption", with_views(f"""SELECT doc_id AS asset_id, CASE WHEN contains(t, 'clock') THEN 'Black analog clock on a dark background' WHEN contains(t, 'beach') THEN 'Foggy beach at sunrise'
    WHEN {any_in('t', ['flower', 'garden'])} THEN 'Purple flowers growing in a garden' WHEN {any_in('t', ['city', 'skyline'])} THEN 'City skyline viewed through haze'
    WHEN contains(t, 'mountain') THEN 'Mountain landscape view under blue sky' WHEN contains(t, 'receipt') THEN 'Store purchase receipt document'
    WHEN contains(t, 'passport') THEN 'Official passport document page' ELSE 'Photo capturing scenic subject composition' END AS caption
    FROM (SELECT doc_id, lower(text) AS t FROM documents)"""))
def ingest_caption(spark, sf):
    d = W.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("asset_id"), RF.ingest_caption(F.col("text")).alias("caption"))


# --- pixels and hashes --------------------------------------------------------------------------

@query("ahash", with_views("SELECT asset_id, p_hash FROM hashed", "hashed"))
def ahash(spark, sf):
    d = W.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("asset_id"), H.ahash64(W.letter_grid(F.col("text"), F.col("n_chars"))).alias("p_hash"))


@query("dhash", f"""SELECT asset_id, lpad(lower(to_hex(CAST(list_sum(list_transform(range(64), lambda i:
        CASE WHEN g[i // 8 * 9 + i % 8 + 1] > g[i // 8 * 9 + i % 8 + 2] THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END)) AS UBIGINT))), 16, '0') AS p_hash
    FROM (SELECT doc_id AS asset_id, {grid('text', 72)} AS g FROM documents)""")
def dhash(spark, sf):
    d = W.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("asset_id"), H.dhash64(W.letter_grid(F.col("text"), F.col("n_chars"), 72)).alias("p_hash"))


RASTER = """
sized AS (SELECT doc_id AS asset_id, hex(text) AS hx, strlen(text) AS n, CAST(floor(sqrt(strlen(text))) AS BIGINT) AS w FROM documents WHERE text <> ''),
raster AS (SELECT asset_id, w, (n + w - 1) // w AS h, list_resize(list_transform(regexp_extract_all(hx, '..'), lambda x: CAST('0x' || x AS BIGINT)),
    (n + w - 1) // w * w, 0) AS g FROM sized),
edges AS (SELECT *, least(2, w // 4, h // 4) AS m, list_transform(range(w * h), lambda i:
    CASE WHEN i % w = 0 OR i % w = w - 1 OR i // w = 0 OR i // w = h - 1 THEN g[i + 1]
    ELSE least(255, greatest(0, 8 * g[i + 1] - g[i] - g[i + 2] - g[i + 1 - w] - g[i - w] - g[i + 2 - w] - g[i + 1 + w] - g[i + w] - g[i + 2 + w])) END) AS e FROM raster),
crops AS (SELECT *, list_transform(list_filter(range(w * h), lambda i: i % w >= m AND i % w < w - m AND i // w >= m AND i // w < h - m), lambda i: e[i + 1]) AS c FROM edges),
stats AS (SELECT asset_id, list_sum(g) / len(g) / 255.0 AS b,
    sqrt(CAST(len(e) * list_sum(list_transform(e, lambda x: x * x)) - list_sum(e) * list_sum(e) AS DOUBLE)) / len(e) AS s,
    sqrt(CAST(len(c) * list_sum(list_transform(c, lambda x: x * x)) - list_sum(c) * list_sum(c) AS DOUBLE)) / len(c) AS i FROM crops)"""


@query("pixel_metrics", f"""WITH {RASTER}
SELECT doc_id AS asset_id, coalesce(round(b, 4), 0.5) AS brightness, coalesce(round(1 - b, 4), 0.5) AS darkness, coalesce(round(s, 4), 10.0) AS sharpness,
    round(i, 4) AS edge_stddev_cropped, coalesce(round(least(100.0, greatest(0.0, 100.0 - s * 3.0)), 4), 50.0) AS blur_score
FROM documents LEFT JOIN stats ON asset_id = doc_id""")
def pixel_metrics(spark, sf):
    """Every text's bytes as a grey raster, about as wide as high, its last row filled up with black."""
    size = F.octet_length("text")
    d = W.table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.col("text").cast("binary").alias("data"),
                                               F.greatest(F.lit(1), F.floor(F.sqrt(size))).cast("int").alias("width"), size.alias("size"))
    d = d.withColumn("height", F.ceil(F.col("size") / F.col("width")).cast("int"))
    black = F.lit(bytearray(1))
    full = F.rpad("data", (F.col("width") * F.col("height")).cast("int"), black)
    return Q.raster_metrics(d.select("asset_id", "width", "height", full.alias("data")))


def _palette_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(vocab.PALETTE))
    return f"SELECT * FROM (VALUES {rows}) t(place, name, pr, pg, pb)"


@query("dominant_colours", f"""
WITH palette AS ({_palette_sql()}),
px AS (SELECT doc_id, n_chars % 256 AS r, (n_chars // 7) % 256 AS g, strlen(text) % 256 AS b FROM documents),
near AS (SELECT doc_id, r, g, b, first(name ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), place) AS name FROM px, palette GROUP BY ALL),
lit AS (SELECT *, (r * 299 + g * 587 + b * 114) / 1000 AS luma FROM near),
named AS (SELECT doc_id, list_filter([CASE WHEN luma < 60 THEN 'black' WHEN luma > 200 THEN 'white' END, name, CASE WHEN luma BETWEEN 60 AND 200 THEN 'gray' END], lambda c: c IS NOT NULL) AS c FROM lit)
SELECT doc_id AS asset_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS colours FROM named""")
def dominant_colours(spark, sf):
    d = W.table(spark, sf, "documents")
    r, g, b = F.col("n_chars") % 256, F.floor(F.col("n_chars") / 7) % 256, F.octet_length("text") % 256
    return d.select(F.col("doc_id").alias("asset_id"), joined(H.dominant_colours(r, g, b)).alias("colours"))


@query("is_screenshot", with_views(f"""SELECT asset_id, contains(lower(filename), 'screenshot') OR contains(lower(filename), 'scr_') OR contains(lower(filename), 'screen_')
    OR ((width, height) IN ({', '.join(str(s) for s in vocab.SCREENSHOT_SIZES)})) OR (ends_with(lower(filename), '.png') AND len(list_filter({vocab.SCREENSHOT_RATIOS}, lambda r: abs(width / height - r) < 0.01)) > 0) AS is_screenshot FROM assets""", "assets"))
def is_screenshot(spark, sf):
    a = W.assets(spark, sf)
    return a.select("asset_id", QF.is_screenshot(F.col("filename"), F.col("width"), F.col("height")).alias("is_screenshot"))


@query("pixel_labels", with_views("""SELECT asset_id, array_to_string(list_filter([
    CASE WHEN sharpness >= 45 THEN '★★★★★ Sharp' WHEN sharpness >= 30 THEN '★★★★☆ Sharp' WHEN sharpness >= 15 THEN '★★★☆☆ Moderate' ELSE '★★☆☆☆ Soft' END,
    CASE WHEN brightness > 0.65 THEN '☀ Bright' END, CASE WHEN 1 - brightness > 0.65 THEN '🌑 Dark' END,
    CASE WHEN greatest(0, 100 - sharpness * 3) > 35 THEN '🌫 Blurry' END, CASE WHEN width * height >= 2073600 THEN 'HD High Resolution' END], lambda l: l IS NOT NULL), '|') AS labels FROM metrics""", "metrics"))
def pixel_labels(spark, sf):
    m = W.pixel_metrics(spark, sf)
    blur = QF.blur_score(F.col("sharpness"))
    return m.select("asset_id", joined(QF.pixel_labels(F.lit(None).cast("string"), F.col("sharpness"), F.col("brightness"),
                                                       1 - F.col("brightness"), blur, F.col("width"), F.col("height"))).alias("labels"))


# --- quality ------------------------------------------------------------------------------------

@query("classical_result", with_views("SELECT * FROM classical", "classical"))
def classical_result(spark, sf):
    out = Q.classical_result(W.pixel_metrics(spark, sf))
    return out.select("asset_id", "sharpness", "exposure", "resolution", "brightness", "blur_score")


@query("fuse_providers", with_views("SELECT asset_id, sharpness, exposure, aesthetic::DOUBLE AS aesthetic, resolution, round(overall, 6) AS overall, confidence::DOUBLE AS confidence FROM assessed", "assessed"))
def fuse_providers(spark, sf):
    out = Q.fuse_providers(W.provider_results(spark, sf), W.PROVIDERS)
    return out.select("asset_id", *[F.round(c, 6).alias(c) for c in ["sharpness", "exposure", "aesthetic", "resolution", "overall"]], "confidence")


ADVICE = "CASE i " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ISSUE_TEXTS.items()) + " END"


@query("assess", with_views(f"""SELECT asset_id, {exact_round("overall", 4)} AS overall_score, quality_grade, array_to_string(issues, '|') AS issues, brightness::DOUBLE AS brightness_score, blur_score,
    CASE WHEN len(issues) > 0 THEN 'This image ' || array_to_string(list_transform(issues, lambda i: {ADVICE}), ' and ') || '. Consider reviewing or replacing it.'
        WHEN quality_grade IN ('EXCELLENT', 'GOOD') THEN 'This image appears to be high quality with no detected problems.'
        ELSE 'Image quality is acceptable; no specific issues detected.' END AS recommendation FROM graded""", "graded"))
def assess(spark, sf):
    out = Q.assess(W.assets(spark, sf), W.provider_results(spark, sf), W.PROVIDERS)
    return out.select("asset_id", "overall_score", "quality_grade", joined("issues").alias("issues"), "brightness_score", "blur_score", "recommendation")


@query("fallback_assessment", with_views("""SELECT asset_id, 0.5::DOUBLE AS overall_score, 0.0::DOUBLE AS confidence, 'FAIR' AS quality_grade, 'UNKNOWN' AS issues,
    'Quality assessment could not be completed.' AS recommendation FROM assets WHERE asset_id NOT IN (SELECT doc_id FROM labels)""", "assets"))
def fallback_assessment(spark, sf):
    """Only labelled assets have provider results here; the others get the neutral row."""
    labelled = _tables(spark, sf)["quality"]
    out = Q.assess(W.assets(spark, sf), W.provider_results(spark, sf).join(labelled, "asset_id", "left_semi"), W.PROVIDERS)
    return out.join(labelled, "asset_id", "left_anti").select(
        "asset_id", "overall_score", "confidence", "quality_grade", joined("issues").alias("issues"), "recommendation")


@query("reuse_metrics", with_views("""SELECT m.asset_id, coalesce(l.quality * 0.5, m.brightness)::DOUBLE AS brightness, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS brightness_source
    FROM metrics m LEFT JOIN labels l ON l.doc_id = m.asset_id""", "metrics"))
def reuse_metrics(spark, sf):
    m = W.pixel_metrics(spark, sf).join(W.table(spark, sf, "labels").withColumnRenamed("doc_id", "asset_id"), "asset_id", "left")
    none = F.lit(None).cast("double")
    cols = {"stored_brightness": F.col("quality") * 0.5, "computed_brightness": F.col("brightness"), "stored_blur_score": none,
            "computed_blur_score": F.col("blur_score"), "stored_sharpness": none, "computed_sharpness": F.col("sharpness")}
    return Q.reuse_metrics(m.select("asset_id", *[c.alias(k) for k, c in cols.items()])).select("asset_id", "brightness", "brightness_source")


@query("upsert_quality", with_views("""SELECT asset_id, CASE WHEN asset_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'POOR' ELSE quality_grade END AS quality_grade FROM quality
    """, "quality"))
def upsert_quality(spark, sf):
    old = W.quality(spark, sf).select("asset_id", "quality_grade")
    return Q.upsert_quality(old, _low(spark, sf).withColumn("quality_grade", F.lit("POOR")))


@query("quality_of", with_views("SELECT asset_id, quality_grade FROM quality WHERE asset_id IN (SELECT vec_id FROM embeddings)", "quality"))
def quality_of(spark, sf):
    return Q.quality_of(W.quality(spark, sf), W.vectors(spark, sf)).select("asset_id", "quality_grade")


# --- records --------------------------------------------------------------------------------------

NULLS = one_of(vocab.NULL_WORDS)


def _norm_list(c: str, n: int) -> str:
    return (f"list_sort(list_distinct(list_filter(list_transform({c}, lambda w: lower({strip('w')})), "
            f"lambda w: w <> '' AND w NOT IN {NULLS})))[1:{n}]")


KEPT = "n_chars % 3 = 0 OR (n_chars % 11 <> 0 AND n_chars % 13 <> 0)"


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN {strip(c)} <> '' AND lower({strip(c)}) NOT IN {NULLS} THEN substring({strip(c)}, 1, {n}) END"


@query("normalise_record", f"""
SELECT doc_id AS media_asset_id, upper(substring(cap, 1, 1)) || substring(cap, 2) AS caption, {texts(vocab.SCENES)}[1 + n_chars % 21] AS scene,
    array_to_string({_norm_list("string_split(text, ' ')", 30)}, '|') AS objects,
    array_to_string({_norm_list("string_split(text, chr(10))", 20)}, '|') AS activities,
    array_to_string({_norm_list("string_split(text, '.')", 20)}, '|') AS keyword_tags,
    '#' || lpad(upper(to_hex(n_chars)), 6, '0') || '|#ABCDEF' AS dominant_colors,
    CAST(least(100, round_even(n_chars / 8, 0)) AS INT) AS people_count, least(1.0, n_chars / 1000)::DOUBLE AS ai_confidence,
    CASE WHEN lang <> 'fr' THEN lang END AS location_guess, n_chars % 2 = 0 AS travel_event
FROM (SELECT *, {_cut('text', 500)} AS cap FROM documents WHERE {KEPT})""")
def normalise_record(spark, sf):
    out = R.normalise_records(W.raw_responses(spark, sf))
    return out.select(
        "media_asset_id", "caption", "scene", joined("objects").alias("objects"), joined("activities").alias("activities"),
        joined("keyword_tags").alias("keyword_tags"), joined("dominant_colors").alias("dominant_colors"), "people_count",
        "ai_confidence", "location_guess", "travel_event",
    )


@query("parse_errors", f"""SELECT doc_id AS media_asset_id, CASE WHEN n_chars % 11 = 0 THEN 'Provider response parsed to non-object JSON structure.'
    ELSE 'Failed to parse JSON response' END AS parse_error FROM documents WHERE NOT ({KEPT})""")
def parse_errors(spark, sf):
    return R.parse_records(W.raw_responses(spark, sf)).filter("parse_error is not null").select("media_asset_id", "parse_error")


@query("merge_record", with_views(f"""SELECT coalesce(r.asset_id, d.doc_id) AS media_asset_id, CASE WHEN d.doc_id IS NOT NULL THEN {texts(vocab.SCENES)}[1 + n_chars % 21] ELSE r.scene END AS scene,
    document_type, event_type, CASE WHEN d.doc_id IS NOT NULL THEN CAST(least(100, round_even(n_chars / 8, 0)) AS INT) ELSE r.people_count END AS people_count, p_hash
    FROM records r JOIN hashed h ON h.asset_id = r.asset_id FULL JOIN (SELECT * FROM documents WHERE {KEPT}) d ON d.doc_id = r.asset_id""", "records", "hashed"))
def merge_record(spark, sf):
    """Normalised answers merged into the stored records; the stored hash survives."""
    d = W.table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), H.ahash64(W.letter_grid(F.col("text"), F.col("n_chars"))).alias("p_hash"))
    old = W.records(spark, sf).join(d, "asset_id").withColumnRenamed("asset_id", "media_asset_id")
    out = R.merge_records(old, R.normalise_records(W.raw_responses(spark, sf)))
    return out.select("media_asset_id", "scene", "document_type", "event_type", F.col("people_count").cast("int").alias("people_count"), "p_hash")


DESCRIBED = f"""
SELECT doc_id AS asset_id, lower(text) AS name, {texts(vocab.SCENE_LABELS)}[1 + n_chars % 11] AS sl, {texts(vocab.OBJECT_LABELS)}[1 + n_chars % 19] AS ol,
    CASE WHEN lang = 'en' THEN 'blue' WHEN lang = 'fr' THEN 'black' ELSE 'red' END AS colour FROM documents"""


@query("describe_assets", f"""
WITH base AS ({DESCRIBED}),
mapped AS (SELECT *, coalesce({', '.join(f"CASE WHEN contains(sl, '{w}') THEN '{w}' END" for w in vocab.SCENE_RULES)}, 'indoor') AS scene,
    coalesce({', '.join(f"CASE WHEN contains(ol, '{w}') THEN '{w}' END" for w in vocab.OBJECT_RULES)}) AS obj,
    CASE WHEN contains(ol, 'receipt') THEN 'receipt' WHEN contains(ol, 'passport') THEN 'passport' END AS document_type FROM base),
filled AS (SELECT *, CASE WHEN obj IS NOT NULL THEN [obj] WHEN contains(name, 'clock') THEN ['clock'] WHEN contains(name, 'flower') THEN ['flower'] WHEN contains(name, 'mountain') THEN ['mountain']
    WHEN contains(name, 'car') THEN ['car'] WHEN contains(name, 'dog') THEN ['dog'] WHEN scene = 'beach' THEN ['ocean', 'sand'] WHEN scene = 'mountain' THEN ['mountain', 'sky']
    WHEN scene = 'garden' THEN ['flower', 'plant'] WHEN scene = 'city' THEN ['building', 'street'] WHEN scene = 'forest' THEN ['tree', 'forest'] ELSE [] END AS objects FROM mapped),
topics AS (SELECT *, list_concat([scene], objects, [colour], CASE WHEN objects[1] = 'clock' THEN ['analog', 'time', 'dial', 'wall'] WHEN objects[1] = 'flower' THEN ['blossom', 'flora', 'garden', 'nature']
    WHEN scene = 'mountain' THEN ['peak', 'landscape', 'outdoors', 'scenery'] WHEN scene = 'beach' THEN ['ocean', 'sand', 'waves', 'coast'] ELSE [] END) AS raw FROM filled)
SELECT asset_id, scene, array_to_string(objects, '|') AS objects, document_type, CASE WHEN scene = 'indoor' THEN 'indoor' ELSE 'outdoor' END AS indoor_outdoor,
    CASE WHEN objects[1] = 'clock' THEN upper(colour[1:1]) || colour[2:] || ' analog clock on a dark background'
        WHEN objects[1] = 'flower' OR scene = 'garden' THEN upper(colour[1:1]) || colour[2:] || ' flowers growing in a garden'
        WHEN scene = 'mountain' OR objects[1] = 'mountain' THEN 'Mountain landscape view under ' || colour || ' sky'
        WHEN scene = 'beach' THEN 'Foggy beach at sunrise with ocean view' WHEN scene = 'city' THEN 'City skyline viewed through haze'
        WHEN document_type = 'receipt' OR contains(name, 'receipt') THEN 'Store purchase receipt document'
        WHEN document_type = 'passport' OR contains(name, 'passport') THEN 'Official passport document page'
        WHEN len(objects) > 0 THEN upper(colour[1:1]) || colour[2:] || ' ' || objects[1] || ' in a ' || scene || ' setting'
        ELSE upper(scene[1:1]) || scene[2:] || ' scene with ' || colour || ' color tones' END AS caption,
    array_to_string(list_filter(list_filter(raw, lambda w, i: list_position(raw, w) = i), lambda w: len(w) >= 3 AND w NOT IN {one_of(vocab.TEMPLATE_WORDS)}), '|') AS keywords
FROM topics""")
def describe_assets(spark, sf):
    """Documents with a scene and an object label each; the text takes the file name's part."""
    d = W.table(spark, sf, "documents")
    n, lang = F.col("n_chars"), F.col("lang")
    pick = lambda words, m: F.get(X.words_array(words), (n % m).cast("int"))
    out = R.describe_assets(d.select(
        F.col("doc_id").alias("asset_id"), F.col("text").alias("filename"), F.lit(2).alias("width"), F.lit(1).alias("height"),
        pick(vocab.SCENE_LABELS, 11).alias("scene_label"), pick(vocab.OBJECT_LABELS, 19).alias("object_label"),
        F.array(F.when(lang == "en", "blue").when(lang == "fr", "black").otherwise("red")).alias("colours"),
    ))
    return out.select("asset_id", "scene", joined("objects").alias("objects"), "document_type", "indoor_outdoor", "caption",
                      joined("keyword_keys").alias("keywords"))


@query("filename_hints", f"""
SELECT doc_id AS asset_id, scene, CASE WHEN contains(name, 'clock') THEN 'clock' WHEN {any_in('name', ['flower', 'garden'])} AND NOT {any_in('name', ['beach', 'coast', 'mountain'])} THEN 'flower'
    WHEN {any_in('name', ['city', 'skyline'])} AND NOT {any_in('name', ['beach', 'coast', 'mountain', 'flower', 'garden'])} THEN 'building'
    WHEN contains(name, 'flower') THEN 'flower' WHEN contains(name, 'mountain') THEN 'mountain' WHEN contains(name, 'car') THEN 'car' WHEN contains(name, 'dog') THEN 'dog'
    WHEN scene = 'beach' THEN 'ocean|sand' WHEN scene = 'mountain' THEN 'mountain|sky' WHEN scene = 'garden' THEN 'flower|plant' WHEN scene = 'city' THEN 'building|street' ELSE '' END AS objects
FROM (SELECT *, CASE WHEN contains(name, 'clock') THEN 'indoor' WHEN {any_in('name', ['beach', 'coast'])} THEN 'beach' WHEN contains(name, 'mountain') THEN 'mountain'
    WHEN {any_in('name', ['flower', 'garden'])} THEN 'garden' WHEN {any_in('name', ['city', 'skyline'])} THEN 'city' WHEN n_chars % 1000 > 500 THEN 'outdoor' ELSE 'indoor' END AS scene
    FROM (SELECT *, lower(text) AS name FROM documents))""")
def filename_hints(spark, sf):
    d = W.table(spark, sf, "documents")
    none, no_list = F.lit(None).cast("string"), X.empty_words()
    h = RF.filename_hints(F.col("text"), F.col("n_chars") % 1000, F.lit(500), none, no_list)
    out = d.select(F.col("doc_id").alias("asset_id"), h.alias("h"))
    return out.select("asset_id", "h.scene", joined("h.objects").alias("objects"))


KEYWORDS = f"""SELECT asset_id, list_filter(list_transform(list_concat([scene], objects, dominant_colors, CASE scene WHEN 'mountain' THEN ['peak', 'landscape', 'outdoors', 'scenery']
        WHEN 'beach' THEN ['ocean', 'sand', 'waves', 'coast'] ELSE [] END), lambda w: lower(w)), lambda w: len(w) >= 3 AND w NOT IN {one_of(vocab.TEMPLATE_WORDS)}) AS k FROM records"""


@query("keyword_map", with_views("""SELECT asset_id, len(list_distinct(k)) + 1 AS entries, array_to_string(list_sort(list_distinct(k)), '|') AS words, p_hash
    FROM raw JOIN hashed USING (asset_id)""", "records", "hashed", raw=KEYWORDS))
def keyword_map(spark, sf):
    r = W.records(spark, sf).join(ahash(spark, sf), "asset_id")
    m = RF.keyword_map(F.col("scene"), F.col("objects"), F.col("dominant_colors"), F.col("p_hash"))
    out = r.select("asset_id", m.alias("m"))
    words = F.sort_array(F.map_keys(F.map_filter("m", lambda k, v: v == str(vocab.KEYWORD_VALUE))))
    return out.select("asset_id", F.size("m").cast("long").alias("entries"), joined(words).alias("words"), F.try_element_at("m", F.lit("p_hash")).alias("p_hash"))


@query("restore_hashes", with_views("""SELECT asset_id AS media_asset_id, p_hash, CASE WHEN asset_id IN (SELECT doc_id FROM labels) THEN '0.5' END AS blur_score FROM hashed""", "hashed"))
def restore_hashes(spark, sf):
    """Only labelled assets have a metric map before; its other keys stay."""
    old = _tables(spark, sf)["quality"].select(
        F.col("asset_id").alias("media_asset_id"),
        F.create_map(F.lit("blur_score"), F.lit("0.5"), F.lit("p_hash"), F.lit("stale")).alias("metrics"))
    new = ahash(spark, sf).withColumnRenamed("asset_id", "media_asset_id")
    out = R.restore_hashes(old, new)
    return out.select("media_asset_id", F.try_element_at("metrics", F.lit("p_hash")).alias("p_hash"),
                      F.try_element_at("metrics", F.lit("blur_score")).alias("blur_score"))


@query("backfill_status", f"""SELECT doc_id AS asset_id, CASE WHEN html IS NOT NULL AND lang = 'en' THEN 'COMPLETED' WHEN lang = 'en' THEN 'SKIPPED_NO_PROVIDER' ELSE 'PENDING' END AS processing_status,
    CASE WHEN html IS NOT NULL AND lang = 'en' THEN {US}({NOW}) END AS processed_at FROM documents LEFT JOIN pages ON page_id = doc_id""")
def backfill_status(spark, sf):
    d = W.table(spark, sf, "documents").join(W.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "left")
    r = d.select(F.col("doc_id").alias("asset_id"), F.col("html").alias("caption"), W.at(W.NOW).alias("analysis_timestamp"),
                 F.lit(None).cast("timestamp").alias("processed_at"),
                 F.when(F.col("lang") == "en", "SKIPPED_NO_PROVIDER").otherwise("PENDING").alias("processing_status"))
    return R.backfill_status(r).select("asset_id", "processing_status", epoch("processed_at"))


@query("analysis_prompt", with_views("""SELECT asset_id, 'Analyze the provided image and generate the conforming Knowledge Record JSON object.' || chr(10) || chr(10) ||
    'Here is some reliable, pre-extracted context from the file''s metadata to assist your analysis:' || chr(10) ||
    '- Capture Time: ' || strftime(taken_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || CASE WHEN c_name IS NOT NULL THEN '- Camera: ' || c_name || ' ' || c_mktsegment || chr(10) ELSE '' END ||
    '- Original Filename: ' || filename || chr(10) || chr(10) ||
    'Use this context to resolve ambiguities (for example, using GPS coordinates to determine the location or timestamps for the season/event, if applicable).' AS prompt
    FROM assets LEFT JOIN customer ON c_custkey = asset_id""", "assets"))
def analysis_prompt(spark, sf):
    c = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), "c_name", "c_mktsegment")
    a = W.assets(spark, sf).join(c, "asset_id", "left")
    none = F.lit(None).cast("double")
    taken = F.concat(F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return a.select("asset_id", RF.analysis_prompt(taken, F.col("c_name"), F.col("c_mktsegment"), none, none, F.col("filename")).alias("prompt"))
