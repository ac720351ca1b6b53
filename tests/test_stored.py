"""Stored tables changed in place against the same changes of whole tables."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from albumetry.operators import catalog as C
from albumetry.operators import vectors as V
from albumetry.operators.stored import StoredTable, purge_stored, reset_stored


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def rows(df, *order):
    return sorted((tuple(map(str, (r[c] for c in order or df.columns))) for r in df.collect()))


def vectors(spark, n=200):
    return spark.range(n).select(F.col("id").alias("asset_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model_name"),
                                 F.array(*[(F.col("id") * k % 97).cast("float") for k in range(1, 5)]).alias("embedding"))


def unchanged(before, path, buckets):
    after = files(path)
    return {f: t for f, t in before.items() if int(f.split("=")[1].split("/")[0]) not in buckets}.items() <= after.items()


def test_upsert_equals_the_whole_table(spark, tmp_path):
    path, old = str(tmp_path / "v"), vectors(spark)
    table = StoredTable(spark, path, buckets=16).create(old)
    before = files(path)
    new = spark.createDataFrame([(3, "a", [9.0] * 4), (4, "a", [8.0] * 4), (5000, "b", [7.0] * 4), (None, "b", [6.0] * 4)],
                                "asset_id long, model_name string, embedding array<float>")
    wanted = V.upsert_vectors(old, new)
    buckets = table.upsert(new, ["asset_id", "model_name"])
    assert rows(table.read()) == rows(wanted) and 0 < len(buckets) <= 4 and unchanged(before, path, buckets)
    table.upsert(new, ["asset_id", "model_name"])  # again: nothing changes
    assert rows(table.read()) == rows(wanted)
    with pytest.raises(ValueError):
        table.upsert(new, ["model_name"])
    with pytest.raises(Exception):
        table.create(old)


def test_delete_equals_the_whole_table(spark, tmp_path):
    path, old = str(tmp_path / "v"), vectors(spark, 40)
    table = StoredTable(spark, path, buckets=64).create(old)
    before = files(path)
    ids = spark.createDataFrame([(3,), (4,), (3,), (999,), (None,)], "asset_id long")
    buckets = table.delete(ids, F.col("model_name") == "a")
    assert rows(table.read()) == rows(V.delete_vectors(old, ids, "a")) and unchanged(before, path, buckets)
    table.delete(ids)
    assert rows(table.read()) == rows(V.delete_vectors(old, ids))
    assert len(glob.glob(f"{path}/bucket=*")) < len({f.split("/")[0] for f in before})  # an emptied bucket is gone
    assert table.delete(ids.filter("false")) == []


def test_purge_and_reset(spark, tmp_path):
    assets = spark.range(60).select(F.col("id").alias("asset_id"), F.lit("READY").alias("status"), F.lit("x").alias("error_message"))
    child = spark.range(120).select((F.col("id") % 70).alias("asset_id"), F.col("id").alias("n"))
    stored = {"assets": StoredTable(spark, str(tmp_path / "a"), buckets=8).create(assets),
              "quality": StoredTable(spark, str(tmp_path / "q"), buckets=8).create(child)}
    ids = spark.createDataFrame([(1,), (2,), (65,)], "asset_id long")
    purge_stored(stored, ids)
    whole = C.purge({"assets": assets, "quality": child}, ids)
    assert all(rows(stored[k].read(), *whole[k].columns) == rows(whole[k]) for k in whole)
    again = spark.createDataFrame([(5,), (6,)], "asset_id long")
    reset_stored(stored["assets"], {"quality": stored["quality"]}, again)
    parent, children = C.reset_for_reprocess(whole["assets"], {"quality": whole["quality"]}, again)
    assert rows(stored["assets"].read(), *parent.columns) == rows(parent)
    assert rows(stored["quality"].read(), *child.columns) == rows(children["quality"])


def test_a_bucket_is_pruned_before_it_is_read(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "v"), buckets=16).create(vectors(spark))
    some = table.read([3])
    assert len(some.inputFiles()) >= len(glob.glob(f"{tmp_path}/v/bucket=3/*.parquet"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"bucket#\d+ = 3", plan)
