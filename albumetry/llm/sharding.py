"""Sharding by vector bin packing on bytes, tokens and rows.

Equal texts form a group. Small groups are bundled by hash, so that the number of things to place is bounded by a
parameter and not by the number of documents; a group above a bundle's share of bytes, tokens or rows is placed as a
thing of its own, whole. Only groups above ``CUT`` of a shard are cut, row by row at random into parts of a bundle's
share, so one text that fills a third of the table still spreads evenly. The things to place, heaviest first, each go to
the shard where the dot product of their (bytes, tokens, rows) with the shard's residual capacity is highest.

Rows are numbered by bundle and, in groups placed alone, by part, whether these parts lie in one shard or not: no
numbering task holds much more than a bundle's share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetry.llm.tables import word_count, written

SHARDS = 8
BUNDLES = 4096  # by hash; with the parts of larger groups at most seven times as many rows on the driver
CUT = 0.25  # of a shard's share of bytes, tokens or rows: groups above it are cut


def place_bundles(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``loads`` (bundles x resources), placed heaviest first by the dot-product rule."""
    share = loads / np.maximum(loads.sum(axis=0), 1)
    capacity = np.full((shards, loads.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -share.sum(axis=1))):
        at = int(np.argmax(capacity @ share[i]))
        chosen[i] = at
        capacity[at] -= share[i]
    return chosen


def shard(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """A shard for every document, sizes near equal (law ``bytes``), equal texts together where that allows it.

    Returns doc_id, size (UTF-8 bytes + 1), tokens (words), text_crc32, law, shard, slot (gapless from 0 within the
    shard) and grown_shard (null under this law). Null text counts as an empty text. Rows that repeat are all placed.
    A group of equal texts stays in one shard unless it holds more than ``CUT`` of a shard's bytes, tokens or rows; then
    its rows are spread over as many parts as its share needs, be their ids equal or not. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), word_count(F.col("text")).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"),
    ))
    load = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*load).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, total[c] or 0))) for c in "btr"])
    # only groups above a bundle's share of a resource: at most 3 * ``bundles`` rows, as many parts and once more as many
    large = rows.groupBy("_group").agg(*load).select("_group", share.alias("_share")).filter(F.col("_share") > 1 / bundles)
    large = large.select("_group", F.ceil(F.col("_share") * bundles).cast("long").alias("_parts"), (F.col("_share") > CUT / shards).alias("_cut"))
    # a number of each written row, drawn once, so that rows which share id and text are dealt out too
    deal = F.pmod(F.xxhash64("_line"), F.col("_parts"))
    rows = rows.withColumn("_line", F.monotonically_increasing_id()).join(F.broadcast(large), "_group", "left").withColumns({
        "_bundle": F.when(F.col("_parts").isNull(), F.pmod(F.xxhash64("_group"), F.lit(bundles))).otherwise(F.col("_group")),
        "_part": F.coalesce(deal, F.lit(-1)),  # -1: a bundle of small groups
        "_alone": F.when(F.col("_cut"), deal).otherwise(F.when(F.col("_parts").isNull(), -1).otherwise(-2)),
    })
    rows = written(rows.drop("_parts", "_cut", "_line"))
    loads = rows.groupBy("_bundle", "_alone", "_part").agg(*load).orderBy("_bundle", "_alone", "_part").toPandas()
    things = loads.groupby(["_bundle", "_alone"])  # what is placed as one
    chosen = place_bundles(things[["b", "t", "r"]].sum().to_numpy(dtype=float).reshape(-1, 3), shards)[things.ngroup().to_numpy(dtype=int)]
    first = loads.assign(shard=chosen).groupby("shard")["r"].cumsum() - loads["r"] if len(loads) else loads["r"]
    placed = spark.createDataFrame(
        [(int(b), int(p), int(s), int(f)) for b, p, s, f in zip(loads["_bundle"], loads["_part"], chosen, first)],
        "_bundle long, _part long, shard int, _first long")
    inside = Window.partitionBy("_bundle", "_part").orderBy("_group", "doc_id")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(placed), ["_bundle", "_part"])
        .select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("_first") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
