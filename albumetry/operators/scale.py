"""Building blocks that keep hot keys out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.session import written

ROWS_PER_TASK = 1_000_000


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: str,
    count: str = "n",
    rows_per_task: int = ROWS_PER_TASK,
    how: str = "left",
) -> DataFrame:
    """Join rows to a table with one line per key, splitting the hot keys.

    ``table[count]`` holds how many rows carry the key. A key with more than ``rows_per_task`` rows is spread over as
    many tasks as its count asks for, by the hash of column ``spread_by`` (stable when a task is rerun). There can be at
    most rows / rows_per_task hot keys, which bounds the broadcast list. The table is evaluated once.
    """
    table = written(table)
    parts = F.ceil(F.col(count) / rows_per_task).cast("int")
    hot = table.filter(F.col(count) > rows_per_task).select(key, parts.alias("_parts"))
    spread = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts")).cast("int"), F.lit(0))
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", spread).drop("_parts")
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted_rows.join(salted_table, [key, "_salt"], how).drop("_salt")


def maybe_among(rows: DataFrame, ids: DataFrame, key: str, bits: int = 20, how: str = "left_semi") -> DataFrame:
    """``rows`` without most of those whose key is not among ``ids``; none that is among them goes.

    A filter by hash, to be followed by the exact join: the marks of the ids, at most 2^``bits`` rows whatever their
    number, go to the tasks that scan ``rows``, so that what cannot match is dropped where it is read and never shuffled.
    With ``how="left_anti"``, the rows that are dropped so.
    """
    mark = F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")
    marks = ids.select(mark.alias("_mark")).distinct()
    # the mark is no column of the rows, so that the planner can move the filter below their own joins
    return rows.join(F.broadcast(marks), mark == F.col("_mark"), how)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based position in a total order without a single-task window.

    Rows are range-partitioned; each gets its place inside the partition plus
    the sizes of the earlier partitions (one small row per partition).
    """
    from pyspark.sql import Window

    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = written(parts)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_part", "_before")
    )


SLICE = 100_000  # rows that a page is cut from by a sort
STEPS = 4096  # parts of the key's range counted at a time: as many rows on the driver


def page_of(df: DataFrame, key: Column, ties: list[Column], offset: int, limit: int, slice_rows: int = SLICE) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of a whole-number key and ``ties``; null keys come last.

    The whole is never sorted: the key's range is counted in equal parts, those that the page lies in are counted again in finer
    ones, until about ``slice_rows`` rows or a single key are left; only these are sorted. The number of passes grows with
    the logarithm of the range. Each pass reads the key alone.
    """
    rows = df.withColumn("_key", F.coalesce(key.cast("long"), F.lit(1 << 62)))
    first = rows.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count("*").alias("n")).first()
    low, high, n, before = first["lo"] or 0, first["hi"] or 0, first["n"], 0
    while n > max(slice_rows, limit) and low < high and before + n > offset:
        width = (high - low) // STEPS + 1
        inside = rows.filter(F.col("_key").between(low, high)).select(F.expr(f"(_key - {low}L) div {width}L").alias("part"))
        counts = {r["part"]: r["count"] for r in inside.groupBy("part").count().collect()}  # at most STEPS rows
        at, kept = before, []
        for part in sorted(counts):
            if at < offset + limit and at + counts[part] > offset:
                kept.append((part, at))
            at += counts[part]
        (least, skipped), (most, _) = kept[0], kept[-1]
        low, high, before = low + least * width, min(high, low + (most + 1) * width - 1), skipped
        if n == (left := sum(counts[p] for p, _ in kept)) and len(kept) > 1:
            break  # the page needs them all
        n = left
    slice_ = rows.filter(F.col("_key").between(low, high))
    return slice_.orderBy("_key", *ties).offset(max(0, offset - before)).limit(limit).drop("_key")


def keep_newest(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key; Spark cuts each map task to one row per key first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return keep_newest(both, keys, F.col("_batch").desc()).drop("_batch")
