"""Files, pixels and streams; images are written here byte by byte."""

import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from albumetry.operators import ingest as N
from albumetry.operators import vectors as V
from albumetry.sources import files, pixels, providers
from albumetry.streaming import jobs as J


def png(path, grey):
    """8-bit RGB PNG of a grey array."""
    h, w = grey.shape
    raw = b"".join(b"\x00" + np.repeat(row.astype(np.uint8), 3).tobytes() for row in grey)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def folder(tmp_path):
    base = str(tmp_path / "in")
    stripes = np.tile(np.where(np.arange(64) % 8 < 4, 220, 30), (48, 1))
    png(f"{base}/a/stripes.png", stripes)
    png(f"{base}/a/copy.PNG", stripes)
    png(f"{base}/b/flat.png", np.full((40, 40), 128))
    png(f"{base}/b/screenshot_1.png", np.full((10, 30), 250))
    with open(f"{base}/b/broken.jpg", "wb") as f:
        f.write(b"not an image")
    with open(f"{base}/b/notes.txt", "wb") as f:
        f.write(b"text")
    return base


def test_pixel_metrics(spark, tmp_path):
    base = folder(tmp_path)
    images = files.read_pixels(spark, base)
    report = files.decode_report(images).first()
    assert (report["files"], report["undecodable"]) == (5, 1)
    got = {os.path.basename(r["path"]): r for r in pixels.pixel_metrics(images).collect()}
    flat, stripes, broken = got["flat.png"], got["stripes.png"], got["broken.jpg"]
    assert flat["brightness"] == round(128 / 255, 4) and flat["edge_stddev_cropped"] == 0.0 and "gray" in flat["colours"]
    assert flat["ahash"] == "f" * 16 and flat["dhash"] == "0" * 16
    assert stripes["sharpness"] > 50 and stripes["blur_score"] == 0.0 and stripes["ahash"] == got["copy.PNG"]["ahash"]
    assert (broken["brightness"], broken["blur_score"], broken["ahash"], broken["decoded"]) == (0.5, 50.0, None, False)
    assert got["screenshot_1.png"]["is_screenshot"] and not flat["is_screenshot"]


def test_files_and_manifest(spark, tmp_path):
    base = folder(tmp_path)
    counts = {r["category"]: r["count"] for r in files.directory_manifest(spark, base).collect()}
    assert counts == {"a": 2, "b": 3}
    empty = spark.createDataFrame([], "file_hash string, asset_id string")
    marked = N.mark_copies(N.fingerprint(files.scan_files(spark, base)), empty)
    out = str(tmp_path / "manifest")
    files.write_manifest(N.ingest_summary(marked), out, 1.234)
    row = spark.read.json(out).first()
    assert (row["total_images"], row["imported"], row["duplicates_skipped"], row["failed"]) == (5, 3, 1, 1)
    assert row["processing_time_seconds"] == 1.23
    fresh = N.register_assets(marked)
    files.write_partitioned(fresh, str(tmp_path / "cat"), F.lit("2024-03-05").cast("timestamp"))
    assert os.path.isdir(tmp_path / "cat" / "yyyy=2024" / "mm=03")
    assert spark.read.parquet(str(tmp_path / "cat")).count() == 3


def test_catalog_and_vector_tables(spark, tmp_path):
    v = spark.createDataFrame([("a", "clip-V.1", [1.0, 0.0])], "asset_id string, model_name string, embedding array<float>")
    V.write_vectors(v, str(tmp_path / "vec"))
    assert os.path.isdir(tmp_path / "vec" / "model_key=media_embeddings_clip_v_1")
    v.write.parquet(str(tmp_path / "lib" / "vectors"))
    assert files.read_catalog(spark, str(tmp_path / "lib"), "vectors").schema == v.schema


def test_stream_ingest_equals_batch(spark, tmp_path):
    base = folder(tmp_path)
    seen = []
    where = [str(tmp_path / x) for x in ("catalog", "outcome", "chk")]
    for _ in range(2):  # a second run finds nothing new
        J.stream_ingest(spark, base, *where, after=lambda df, i: seen.append(df.count())).awaitTermination()
    catalog = spark.read.option("recursiveFileLookup", True).parquet(where[0])
    assert catalog.count() == 3 and seen == [3]
    png(f"{base}/c/again.png", np.full((40, 40), 128))
    png(f"{base}/c/new.png", np.full((40, 41), 100))
    J.stream_ingest(spark, base, *where).awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).parquet(where[0]).count() == 4
    outcomes = spark.read.option("recursiveFileLookup", True).parquet(where[1]).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in outcomes} == {"new": 4, "skipped": 2, "failed": 1}


def test_lookup_reads_the_folders_of_its_hashes_alone(spark, tmp_path):
    """What a batch of one hash reads does not grow with a catalog of other hashes."""
    import hashlib

    path, outcome, source = str(tmp_path / "catalog"), str(tmp_path / "outcome"), str(tmp_path / "in")
    kind = "path string, filename string, file_size long, file_hash string, is_valid boolean"

    def hashed(n):
        return hashlib.sha256(str(n).encode()).hexdigest()

    for number, names in enumerate([range(120), range(120, 240), [7, 7, 1000]]):
        rows = [(f"/{number}/{k}-{n}", f"{n}.jpg", 1, hashed(n), n != 5) for k, n in enumerate(names)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        J.ingest_stream(spark.readStream.schema(kind).parquet(source), path, outcome, str(tmp_path / "chk")).awaitTermination()
    one = spark.createDataFrame([(hashed(7), True)], "file_hash string, is_valid boolean")
    read = J.known_hashes(spark, path, one, 99).select("file_hash", F.input_file_name().alias("f")).collect()
    assert {r["f"].split("prefix=")[1][:2] for r in read} == {hashed(7)[:2]}
    assert {r["file_hash"] for r in read} == {h for h in map(hashed, [*range(240), 1000]) if h[:2] == hashed(7)[:2]}
    last = spark.read.parquet(f"{outcome}/batch=2").collect()
    assert sorted((r["path"], r["outcome"]) for r in last) == [("/2/0-7", "skipped"), ("/2/1-7", "skipped"), ("/2/2-1000", "new")]
    first = spark.read.parquet(f"{outcome}/batch=0").collect()
    assert {r["outcome"] for r in first if r["path"] == "/0/5-5"} == {"failed"}
    assert spark.read.parquet(path).count() == 240  # 239 of the first two batches, one of the last


EVENTS = [("a", 1, "UPLOADED", None), ("a", 2, "PROCESSING", None), ("a", 3, "READY", None), ("a", 4, "FAILED", "late"),
          ("b", 5, "PROCESSING", None), ("b", 6, "FAILED", "x" * 3000), ("c", 7, "READY", None), ("c", 8, "UPLOADED", None), ("c", 9, "PROCESSING", None)]
SCHEMA = "asset_id string, seq long, state string, error string"


def run_stream(spark, tmp_path, make, name):
    src = str(tmp_path / f"{name}_src")
    spark.createDataFrame(EVENTS, SCHEMA).coalesce(1).write.parquet(src)
    stream = make(spark.readStream.schema(SCHEMA).parquet(src))
    q = (stream.writeStream.format("memory").queryName(name).outputMode("update")
         .option("checkpointLocation", str(tmp_path / f"{name}_chk")).trigger(availableNow=True).start())
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_life_cycles_equal_batch(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    want = {tuple(r) for r in J.asset_lifecycle(events).collect()}
    assert ("a", "READY", None) in want and ("c", "PROCESSING", None) in want
    assert {len(r[2]) for r in want if r[0] == "b"} == {1000}
    assert run_stream(spark, tmp_path, J.stream_asset_lifecycle, "life") == want
    want = {tuple(r) for r in J.analysis_lifecycle(events).collect()}
    assert {r[2] for r in want if r[0] == "b"} == {1}
    assert run_stream(spark, tmp_path, J.stream_analysis_lifecycle, "ana") == want


def test_stream_life_cycles_take_late_events(spark, tmp_path):
    """Several micro-batches in the wrong order give what the batch twins give."""
    schema = "asset_id string, seq long, state string, error string"
    parts = [[("a", 9, "PROCESSING", None), ("b", 9, "COMPLETED", None), ("c", 5, "READY", None), ("d", 4, "FAILED", "late")],
             [("a", 3, "UPLOADED", None), ("b", 3, "FAILED", "old"), ("c", 2, "UPLOADED", None), ("d", 7, "FAILED", "new")],
             [("c", 8, "PROCESSING", None), ("d", 1, "READY", None), ("d", 6, "UPLOADED", None)]]
    src = str(tmp_path / "late")
    ready = spark.createDataFrame([("b",), ("d",), ("d",)], "asset_id string")
    for name, job, twin in (("asset", J.stream_asset_lifecycle, J.asset_lifecycle(spark.createDataFrame(sum(parts, []), schema))),
                            ("gated", lambda e: J.stream_analysis_lifecycle(e, ready),
                             J.analysis_lifecycle(spark.createDataFrame(sum(parts, []), schema), ready))):
        last = {}
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{src}_{name}")
            seen = []
            q = job(spark.readStream.schema(schema).parquet(f"{src}_{name}")).writeStream.foreachBatch(
                lambda d, i: seen.extend(d.collect())).outputMode("update").option(
                "checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
            q.awaitTermination()
            last.update({r["asset_id"]: tuple(r) for r in seen})
        assert set(last.values()) == {tuple(r) for r in twin.collect()}


def test_stream_dedupe(spark, tmp_path):
    src = str(tmp_path / "hashes")
    spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "file_hash string, n int").write.parquet(src)
    out = J.stream_dedupe(spark.readStream.schema("file_hash string, n int").parquet(src))
    q = out.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["file_hash"] for r in spark.table("once").collect()) == ["x", "y"]


def test_dedupe_state_is_bounded(spark, tmp_path):
    """Over many days of new hashes the state holds those of the last ones; catalog hashes never pass."""
    src, kind = str(tmp_path / "days"), "file_hash string, ts timestamp"
    known = spark.createDataFrame([("d0-3",), ("d4-1",)], "file_hash string")
    start, counts = pd.Timestamp("2024-01-01"), []
    for day in range(8):
        rows = [(f"d{day}-{k % 50}", (start + pd.Timedelta(days=day, minutes=k)).to_pydatetime()) for k in range(100)]
        rows += [(f"d{day - 1}-7", (start + pd.Timedelta(days=day)).to_pydatetime())] if day else []
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        out = J.stream_dedupe(spark.readStream.schema(kind).parquet(src), "ts", "1 day", known)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = [r["file_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({f"d{day}-{k}" for day in range(8) for k in range(50)} - {"d0-3", "d4-1"})
    assert max(counts) <= 200  # not the 400 hashes of all days


def test_providers(spark):
    @F.pandas_udf("response string, error string")
    def analyze(path: pd.Series, prompt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"response": ["{}" if p == "good" else None for p in path],
                             "error": ["boom" if p == "bad" else None for p in path]})

    rows = [("a", "READY", "good", ""), ("b", "READY", "bad", ""), ("c", "READY", "none", ""), ("d", "UPLOADED", "good", "")]
    df = spark.createDataFrame(rows, "asset_id string, status string, original_path string, prompt string")
    got = {r["asset_id"]: r["processing_status"] for r in providers.run_vision_provider(df, analyze).collect()}
    assert got == {"a": "COMPLETED", "b": "FAILED", "c": "SKIPPED_NO_PROVIDER"}

    def raises(path: pd.Series, prompt: pd.Series) -> pd.DataFrame:
        if (path == "bad").any():
            raise ValueError("no such model")
        return pd.DataFrame({"response": ["{}"] * len(path), "error": [None] * len(path)})

    got = {r["asset_id"]: (r["processing_status"], r["error_message"]) for r in providers.run_vision_provider(df, raises).collect()}
    assert got == {"a": ("COMPLETED", None), "b": ("FAILED", "no such model"), "c": ("COMPLETED", None)}


def test_quality_follows_analysis(spark, tmp_path):
    step = J.analysis_then_quality(lambda d: d.withColumn("r", F.lit(1)), lambda d: d.withColumn("q", F.lit(2)),
                                   str(tmp_path / "r"), str(tmp_path / "q"))
    df = spark.createDataFrame([("a",)], "asset_id string")
    step(df, 0)
    step(df, 0)  # a retried batch is not doubled
    assert spark.read.parquet(str(tmp_path / "r")).count() == spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_failure_between_both_writes(spark, tmp_path):
    """A retried batch goes on after its last commit and gives each row once, whatever the model would answer then."""
    record, quality, commits = (str(tmp_path / x) for x in ("r", "q", "c"))
    answers, broken = iter(range(10)), [True]

    def assess(d):
        if broken:
            broken.clear()
            raise RuntimeError("lost")
        return d.withColumn("q", F.lit(2))

    step = J.analysis_then_quality(lambda d: d.withColumn("r", F.lit(next(answers))), assess, record, quality, commits)
    first, second = (spark.createDataFrame([(x,)], "asset_id string") for x in "ab")
    with pytest.raises(RuntimeError):
        step(first, 0)
    assert J.committed(spark, record, commits).count() == 0  # half a batch is not read
    step(first, 0)
    step(second, 1)
    step(second, 1)
    assert sorted(map(tuple, J.committed(spark, record, commits).collect())) == [("a", 0), ("b", 1)]
    assert sorted(map(tuple, J.committed(spark, quality, commits).collect())) == [("a", 2), ("b", 2)]


def test_raster_metrics_equal_the_decoded_images(spark):
    """Column expressions against the array code that decoded images go through."""
    import numpy as np

    from albumetry.operators.quality import raster_metrics
    from albumetry.sources.pixels import pixel_row

    rng = np.random.default_rng(4)
    rows = [(k, w, h, bytes(rng.integers(0, 256, w * h, dtype=np.uint8).tolist()))
            for k, (w, h) in enumerate([(1, 1), (1, 9), (9, 1), (2, 2), (3, 3), (4, 4), (7, 5), (8, 8), (31, 17)])]
    rows += [(90, 6, 6, b"\x80" * 36), (91, 5, 8, bytes([255, 0] * 20)), (92, 0, 0, b""), (93, None, None, None)]
    got = {r["asset_id"]: r for r in raster_metrics(spark.createDataFrame(rows, "asset_id int, width int, height int, data binary")).collect()}
    for k, w, h, data in rows:
        if not data:
            assert tuple(got[k])[1:] == (0.5, 0.5, 10.0, None, 50.0)
            continue
        brightness, sharpness, cropped, *_ = pixel_row(w, h, 1, data)
        assert abs(got[k]["brightness"] - brightness) < 6e-5 and abs(got[k]["sharpness"] - sharpness) < 6e-5
        assert abs(got[k]["edge_stddev_cropped"] - cropped) < 6e-5
        assert abs(got[k]["blur_score"] - min(100, max(0, 100 - 3 * sharpness))) < 2e-4
    plan = raster_metrics(spark.createDataFrame(rows, "asset_id int, width int, height int, data binary"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_raster_pixels_are_rows_of_a_compiled_loop(spark):
    """No interpreted lambda runs per pixel; rasters of one id stay apart."""
    import re

    import numpy as np

    from albumetry.operators.quality import raster_metrics
    from albumetry.sources.pixels import pixel_row

    rng = np.random.default_rng(8)
    rows = [(1, w, h, bytes(rng.integers(0, 256, w * h, dtype=np.uint8).tolist())) for w, h in [(400, 301), (13, 7), (13, 7)]]
    out = raster_metrics(spark.createDataFrame(rows, "asset_id int, width int, height int, data binary"))
    want = sorted(pixel_row(w, h, 1, data)[:3] for _, w, h, data in rows)
    got = sorted((r["brightness"], r["sharpness"], r["edge_stddev_cropped"]) for r in out.collect())
    assert len(got) == 3 and all(abs(a - b) < 6e-5 for x, y in zip(got, want) for a, b in zip(x, y))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\*\(\d+\) Generate explode", plan) and "aggregate(" not in plan and "filter(" not in plan


def test_raster_metrics_round_as_the_sql(spark, tmp_path):
    """Means that end in a tie in their shortest form go where the SQL's product with 10,000 lies, up or down."""
    import __spark_entry__ as entry_points
    from tests import compare

    rows = []
    for doc, total in enumerate([34578, 40086, 42534, 38000]):  # 960 pixels, 30 by 32
        low, more = divmod(total, 960)
        rows.append((doc, chr(low + 1) * more + chr(low) * (960 - more), 960))
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "raw"))
    part = next(p for p in os.listdir(tmp_path / "raw") if p.endswith(".parquet"))
    os.rename(tmp_path / "raw" / part, tmp_path / "documents.parquet")
    fn, sql = entry_points.queries()["pixel_metrics"], entry_points.oracle_sql()["pixel_metrics"]
    assert compare.differences(spark, compare.connect(str(tmp_path)), "pixel_metrics", fn, sql, str(tmp_path)) is None
