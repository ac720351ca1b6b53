"""Clean-up recommendations: classes of items, groups, savings, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import quality as Q
from albumetry.functions.text import contains_any
from albumetry.operators import groups as G
from albumetry.operators import pairs as P
from albumetry.session import written


# --- classes of single items -------------------------------------------------------

def low_quality(items: DataFrame) -> DataFrame:
    return items.filter(Q.is_low_quality(F.col("quality_grade"), F.col("overall_score")))


def rank_low_quality(items: DataFrame) -> DataFrame:
    """Worst grade first, then lowest score."""
    return low_quality(items).orderBy(
        Q.grade_weight(F.col("quality_grade")), F.coalesce("overall_score", F.lit(1.0)), "asset_id"
    )


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def is_screenshot_item() -> Column:
    return _low("filename").contains("screenshot") | _low("caption").contains("screenshot") | (_low("document_type") == "screenshot")


def is_document_item(more_types: bool = False) -> Column:
    """``more_types`` also leaves out other, unknown and none (the audit reading)."""
    left_out = ["screenshot", "receipt"] + (vocab.NOT_A_DOCUMENT_TYPE if more_types else [])
    typed = (_low("document_type") != "") & ~_low("document_type").isin(left_out)
    return typed | (F.length(F.coalesce("detected_text", F.lit(""))) > 120)


def is_receipt_item() -> Column:
    return (_low("document_type") == "receipt") | contains_any(_low("detected_text"), vocab.RECEIPT_WORDS)


def is_id_item(audit: bool = False) -> Column:
    text, caption = (
        (vocab.ID_AUDIT_WORDS, vocab.ID_AUDIT_WORDS) if audit else (vocab.ID_TEXT_WORDS, vocab.ID_CAPTION_WORDS)
    )
    return contains_any(_low("detected_text"), text) | contains_any(_low("caption"), caption)


def screenshots(items: DataFrame) -> DataFrame:
    return items.filter(is_screenshot_item())


def documents(items: DataFrame, more_types: bool = False) -> DataFrame:
    return items.filter(is_document_item(more_types))


def receipts(items: DataFrame) -> DataFrame:
    return items.filter(is_receipt_item())


def ids(items: DataFrame, audit: bool = False) -> DataFrame:
    return items.filter(is_id_item(audit))


# --- groups ------------------------------------------------------------------------------

def exact_groups(items: DataFrame) -> DataFrame:
    """Same hash, or (where a hash is missing) same size, time and clean name."""
    return G.copy_groups(G.copy_items(items))


def pair_details(items: DataFrame, columns: list[str], keep_metric_keys: bool = False) -> DataFrame:
    """Rule columns per item: id plus those of ``columns`` that there are."""
    worded = P.with_rule_words(items, keep_metric_keys)
    return worded.select(F.col("asset_id").alias("id"), *[c for c in columns if c in worded.columns])


def with_details(pairs: DataFrame, items: DataFrame, columns: list[str], keep_metric_keys: bool = False) -> DataFrame:
    """Both sides' rule columns; words are split only for items that are in a pair."""
    pairs = written(pairs)
    paired = pairs.select(F.col("a_id").alias("asset_id")).unionByName(pairs.select(F.col("b_id").alias("asset_id"))).distinct()
    details = written(pair_details(items.join(paired, "asset_id", "left_semi"), columns, keep_metric_keys))
    return P.attach_sides(pairs, details)


def near_pairs(items: DataFrame, exact: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Accepted near pairs among items outside exact groups, earlier item left.

    ``details`` gives the columns that the rules read, where ``items`` holds only id, order and hash.
    """
    rest = G.copy_items(items).join(exact.select("id"), "id", "left_anti")
    found = P.near_items(rest, vocab.NEAR_RADIUS)
    return with_details(found, items if details is None else details, P.NEAR_COLUMNS).filter(P.near_valid())


def near_groups(items: DataFrame, exact: DataFrame, details: DataFrame | None = None) -> DataFrame:
    return G.leader_groups(near_pairs(items, exact, details))


def similar_pairs(items: DataFrame, exact: DataFrame, near: DataFrame, keep_metric_keys: bool = False,
                  details: DataFrame | None = None) -> DataFrame:
    """Accepted similar pairs outside exact and near groups."""
    taken = exact.select("id").unionByName(near.select("id"))
    rest = G.copy_items(items).join(taken, "id", "left_anti")
    found = P.near_items(rest, vocab.SIMILAR_RADIUS)
    judged = P.similar_verdict(with_details(found, items if details is None else details, P.SIMILAR_COLUMNS, keep_metric_keys))
    return judged.filter("is_similar").select(
        "a_id", "a_ord", "b_id", "b_ord", "distance", "consistency", "confidence", "reasons", "explanation"
    )


def similar_groups(items: DataFrame, exact: DataFrame, near: DataFrame,
                   details: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Group rows, and per group the highest confidence with its explanation."""
    edges = written(similar_pairs(items, exact, near, details=details))
    grouped = written(G.leader_groups(edges))
    joined = grouped.select(F.col("leader_id").alias("a_id"), F.col("id").alias("b_id")).join(edges, ["a_id", "b_id"])
    best = joined.groupBy(F.col("a_id").alias("leader_id")).agg(
        F.min(F.struct((-F.col("confidence")).alias("minus"), "b_ord", "explanation")).alias("best")
    )
    return grouped, best.select(
        "leader_id", (-F.col("best.minus")).alias("confidence"), F.col("best.explanation").alias("explanation")
    )


# --- totals --------------------------------------------------------------------------------

def category_summary(items: DataFrame, exact: DataFrame, near: DataFrame, hide_empty: bool = True,
                     narrow: DataFrame | None = None) -> DataFrame:
    """Per category: entries (groups count once), items and recoverable bytes.

    ``items`` is read once, for the classes; ``narrow`` may hold the same items without texts for the groups.
    """
    narrow = items if narrow is None else narrow
    flags = items.agg(
        *[
            F.struct(F.count_if(hit).alias("items"), F.coalesce(F.sum(F.when(hit, F.col("file_size"))), F.lit(0)).alias("bytes")).alias(name)
            for name, hit in {
                "low_quality": Q.is_low_quality(F.col("quality_grade"), F.col("overall_score")),
                "screenshots": is_screenshot_item(), "documents": is_document_item(),
                "receipts": is_receipt_item(), "ids": is_id_item(),
            }.items()
        ]
    )
    freed = {"low_quality", "screenshots"}
    parts = flags.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i + 2).alias("place"), F.lit(name).alias("category"),
                        F.col(f"{name}.items").alias("entries"), F.col(f"{name}.items").alias("items"),
                        (F.col(f"{name}.bytes") if name in freed else F.lit(0).cast("long")).alias("bytes"),
                    )
                    for i, name in enumerate(["low_quality", "screenshots", "documents", "receipts", "ids"])
                ]
            )
        ).alias("c")
    ).select("c.*")

    def of_groups(place: int, name: str, grouped: DataFrame) -> DataFrame:
        saved = G.group_savings(G.group_members(grouped, narrow))
        return saved.agg(
            F.lit(place).alias("place"), F.lit(name).alias("category"), F.count("*").alias("entries"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("savings"), F.lit(0)).alias("bytes"),
        )

    out = of_groups(0, "duplicates", exact).unionByName(of_groups(1, "near_duplicates", near)).unionByName(parts)
    return out.filter("items > 0") if hide_empty else out


def recoverable_bytes(summary: DataFrame) -> DataFrame:
    """Sum over categories; an asset in two of them counts twice."""
    return summary.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("recoverable_bytes"))


def distinct_recoverable_bytes(items: DataFrame, exact: DataFrame, near: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """Same, every asset once: copies that are not the largest of their group,
    low quality and screenshots."""
    narrow = items if narrow is None else narrow
    grouped = exact.unionByName(near)
    members = written(G.group_members(grouped, narrow))
    kept = members.groupBy("leader_id").agg(F.min(F.struct((-F.col("file_size")).alias("s"), "ord", "id")).alias("k"))
    spare = members.select("id").join(kept.select(F.col("k.id").alias("id")), "id", "left_anti")
    flagged = items.filter(Q.is_low_quality(F.col("quality_grade"), F.col("overall_score")) | is_screenshot_item())
    ids_ = spare.select(F.col("id").alias("asset_id")).unionByName(flagged.select("asset_id")).distinct()
    return narrow.join(ids_, "asset_id", "left_semi").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("distinct_bytes"))


def library_health(summary: DataFrame, photos: DataFrame) -> DataFrame:
    """Review ratio, health word, insight and biggest opportunity: one row."""
    def of(name: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("category") == name, F.col(c))), F.lit(0))

    cleanup = ["duplicates", "near_duplicates", "low_quality", "screenshots"]
    totals = summary.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("review_items"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("recoverable"),
        of("duplicates", "bytes").alias("dup"), of("near_duplicates", "bytes").alias("near"),
        of("low_quality", "bytes").alias("low"), of("screenshots", "items").alias("shots"),
        F.min(F.when(F.col("category").isin(cleanup) & (F.col("items") > 0),
                     F.struct((-F.col("bytes")).alias("b"), "place", "category")))["category"].alias("biggest_opportunity"),
    )
    n = photos.agg(F.greatest(F.count("*"), F.lit(1)).alias("photos"))
    ratio = F.col("review_items") / F.col("photos")
    insight = (
        F.when((F.col("low") >= F.col("dup")) & (F.col("low") >= F.col("near")), "Most recoverable space comes from Low Quality Photos.")
        .when((F.col("dup") > 0) & (F.col("dup") >= F.col("recoverable") * 0.35),
              "Exact Duplicates account for nearly 40% of recoverable storage.")
        .when((F.col("shots") > 0) & (F.col("shots") <= F.col("photos") * 0.02),
              "Screenshots make up only a small portion of your library.")
        .otherwise("Reviewing duplicate photos first will free the most storage.")
    )
    health = F.when(ratio > 0.30, "Requires Cleanup").when(ratio > 0.10, "Needs Attention").otherwise("Great")
    # two one-row aggregates side by side
    return totals.join(F.broadcast(n)).select(
        "photos", "review_items", F.round(ratio, 6).alias("review_ratio"), health.alias("health"),
        insight.alias("insight"), "biggest_opportunity",
    )
