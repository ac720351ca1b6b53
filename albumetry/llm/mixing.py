"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place in [0, 2^36) by the hash of its id and text. For each source
the words are summed by source and hash bucket (2^12 buckets); the bucket in
which the running sum crosses the budget is the boundary, and only the rows of
that bucket are summed again by their next 12 bits, three times in all. The
result is one hash threshold per source: a document is taken once more if its
hash lies below it. No documents are sorted or collected, a heavy source is cut
to one row per bucket by the map-side sums, and because places never change a
larger budget takes a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetry.llm.tables import kept_whole, unit_hash, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
LEVELS = 3
BITS = 12


def _place(doc_id, text):
    """Hash of id and text, so that rows which share an id do not share a place."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return unit_hash(name, LEVELS * BITS)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) per document: the only pass over texts."""
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _place(F.col("doc_id"), F.col("text")).alias("place")
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) per source.

    Sources by code point (null last) weigh ``weights`` in turn and share all words. A target stops at ``most`` times
    its source; what is left over goes to the others by weight. Closed form: with sources ordered by
    most * size / weight, the first ones stop, and the rest share at one level. One row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    turn = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    per = per.withColumn("_n", F.row_number().over(turn) - 1).withColumn("_w", weight.cast("long"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.col("_before")).cast("double") / (
        F.sum("_w").over(every) - F.col("_w_before"))
    stops = F.col("_cap") < F.col("_level") * F.col("_w")
    per = (
        per.withColumn("_cap", F.col("source_size") * most)
        .withColumn("_before", F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn("_level", level)
    )
    # the first source in the order that does not stop sets the level of all that do not stop
    first = F.min_by("_level", F.struct(F.col("_cap") / F.col("_w"), F.col("_n")))
    shared = per.filter(~stops).agg(first.alias("_at"))
    per = per.crossJoin(F.broadcast(shared))  # one row
    share = F.col("_at") * F.col("_w")
    target = F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), share))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, whole, cut): every document ``whole`` times, and once more below the hash ``cut``.

    ``goal``: (source, source_size, target). A source without words is taken no further.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.select("source", whole.alias("whole"), F.col("target"), F.col("source_size")).select(
        "source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("cut"),
    )
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        inside = F.shiftright("place", shift + BITS) == F.shiftright("cut", shift + BITS)
        here = sized if level == 0 else sized.join(
            state.select(F.col("source").alias("_s"), "cut"), F.col("source").eqNullSafe(F.col("_s"))).filter(inside)
        hist = here.groupBy("source", F.shiftright("place", shift).alias("_b")).agg(F.sum("size").alias("_size"))
        run = Window.partitionBy("source").orderBy("_b")
        hist = hist.withColumn("_upto", F.sum("_size").over(run))
        s = state.select(F.col("source").alias("_s"), "whole", "budget", F.col("cut").alias("_cut"))
        on = F.col("source").eqNullSafe(F.col("_s"))
        last = level == LEVELS - 1
        # a bucket stays below the cut if it fits; the finest one also if it is nearer with than without
        fits = (F.col("_upto") - F.col("_size") / 2.0 if last else F.col("_upto")) <= F.col("budget")
        best = (
            s.join(hist, on, "left").groupBy("_s", "whole", "budget", "_cut")
            .agg(F.max(F.when(fits, F.struct("_b", "_upto"))).alias("_in"), F.min(F.when(~fits, F.col("_b"))).alias("_next"))
        )
        done = F.coalesce(F.col("_in._upto"), F.lit(0))
        # the boundary is the first bucket that does not fit; if all fit, the end of the range
        top = (F.shiftright("_cut", shift + BITS) + 1) * (1 << BITS)
        cut = F.shiftleft(F.coalesce(F.col("_next"), top), shift)
        state = written(best.select(F.col("_s").alias("source"), "whole", (F.col("budget") - done).alias("budget"), cut.alias("cut")))
    return state


def _plan(sized: DataFrame, weights: tuple, most: int) -> DataFrame:
    """(_s, source_size, target, whole, cut) per source."""
    goal = written(targets(sized, weights, most))
    cuts = thresholds(sized, goal).select(F.col("source").alias("_s"), "whole", "cut")
    plan = goal.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).select("_s", "source_size", "target", "whole", "cut")
    return written(plan)  # with its size known, the planner sends it to the texts while it is small


def _times(most: int):
    return F.least(F.lit(most), F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """How often each document is taken so that sources meet their targets.

    Returns doc_id, source, size, source_size, target, times (0 to ``most``) and taken = size * times.
    Null text has size 0; null is a source of its own, ordered last; rows that repeat an id and a text share one hash and are
    taken or left together; an empty table gives no rows. Other columns are ignored. Sources without a word have
    target 0. Reruns agree, as places are hashes of ids and texts.
    """
    sized = written(sizes(docs))
    return (
        sized.join(_plan(sized, weights, most), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("times", _times(most))
        .select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: each document as many rows as it is taken, with the columns of ``docs``; cases as in ``mix``.

    The texts only meet one row per source; they are not shuffled while those rows can be sent to all tasks.
    """
    plan = _plan(written(sizes(docs)), weights, most).select("_s", "whole", "cut")
    rows = kept_whole(docs, "source").withColumn("place", _place(F.col("row.doc_id"), F.col("row.text")))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("times", _times(most)).filter("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
