"""Stored tables that change in place: buckets by key, of which only those that a change touches are written again.

A table is a folder with one partition per bucket of its key. A change of few rows reads the buckets of these rows (the other
folders are pruned before anything is listed or read), writes what is left of them to the shared scratch folder and puts
that in their place. Files of all other buckets keep their names. One writer at a time; a change that is broken off before
it replaces its buckets leaves the table as it was, and every change here can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetry.operators.scale import keep_newest
from albumetry.session import written

BUCKET = "bucket"


class StoredTable:
    """A table stored at ``path`` in ``buckets`` partitions by the hash of column ``key`` (``buckets``: the same for its life)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "asset_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _put(self, rows: DataFrame, mode: str) -> None:
        # a bucket's rows meet in a few tasks of their own, by the hash of the whole row, so that a hot key is not one task
        dealt = rows.select("*", self._bucket()).withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.lit(4)))
        out = dealt.repartition(BUCKET, "_deal").drop("_deal").write.mode(mode).partitionBy(BUCKET)
        out.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, rows: DataFrame) -> StoredTable:
        """Writes the table for the first time; a folder that is there is an error."""
        self._put(rows, "error")
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        rows = self.spark.read.parquet(self.path)
        return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most as many numbers as there are buckets."""
        return sorted(r[BUCKET] for r in keys.select(self._bucket()).distinct().collect())

    def change(self, keys: DataFrame, to: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the rows in the keys' buckets by ``to(rows)``, which must keep each row's key; the buckets written."""
        buckets = self.touched(keys)
        if buckets:
            rows = written(to(self.read(buckets)))  # read to the end before its source is replaced
            self._put(rows, "overwrite")
            self._drop(set(buckets) - set(self.touched(rows)))
        return buckets

    def _drop(self, emptied: set[int]) -> None:
        """Buckets without a row left have no part in an overwrite; their folders go."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for bucket in emptied:
            folder = path(f"{self.path}/{BUCKET}={bucket}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def upsert(self, new: DataFrame, keys: list[str]) -> list[int]:
        """Rows of ``new`` replace those with equal ``keys`` (the table's key among them); of rows that repeat keys, one stays."""
        if self.key not in keys:
            raise ValueError(f"keys must hold {self.key}")
        new = written(keep_newest(new.withColumn("_line", F.monotonically_increasing_id()), keys, F.col("_line").desc()).drop("_line"))

        def merged(old: DataFrame) -> DataFrame:
            # null keys are keys like others
            mine = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            return old.join(mine, same, "left_anti").unionByName(new)

        return self.change(new, merged)

    def delete(self, ids: DataFrame, where: Column | None = None) -> list[int]:
        """Rows whose key is among the ids, and that meet ``where``, go."""
        gone = written(ids.select(F.col(self.key).alias("_gone")).distinct())

        def left(old: DataFrame) -> DataFrame:
            met = F.col(self.key) == F.col("_gone")
            return old.join(gone, met if where is None else met & F.coalesce(where, F.lit(False)), "left_anti")

        return self.change(gone.select(F.col("_gone").alias(self.key)), left)

    def update(self, ids: DataFrame, changes: dict[str, Column]) -> list[int]:
        """Sets columns of the rows whose key is among the ids."""
        chosen = written(ids.select(F.col(self.key).alias("_chosen")).distinct())

        def set_(old: DataFrame) -> DataFrame:
            hit = F.col("_chosen").isNotNull()
            rows = old.join(chosen, F.col(self.key) == F.col("_chosen"), "left")
            return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_chosen")

        return self.change(chosen.select(F.col("_chosen").alias(self.key)), set_)


def purge_stored(tables: dict[str, StoredTable], ids: DataFrame) -> dict[str, list[int]]:
    """The ids' rows leave every table (parent, children and vectors); the buckets written."""
    ids = written(ids.select("asset_id").distinct())
    return {name: t.delete(ids.withColumnRenamed("asset_id", t.key)) for name, t in tables.items()}


def reset_stored(assets: StoredTable, children: dict[str, StoredTable], ids: DataFrame) -> None:
    """Parents back to UPLOADED, children dropped, for a new analysis."""
    ids = written(ids.select("asset_id").distinct())
    columns = assets.read().columns
    blank = {c: F.lit(None) for c in ("thumbnail_path", "error_message") if c in columns}
    now = {"updated_at": F.current_timestamp()} if "updated_at" in columns else {}
    purge_stored(children, ids)
    assets.update(ids, {"status": F.lit("UPLOADED"), **blank, **now})
