"""Data audits over hashes, records and the recommendation funnel."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.hashes import VALID_HASH, bit_distance, hash_bits
from albumetry.functions.text import base_name
from albumetry.operators import groups as G
from albumetry.operators import pairs as P
from albumetry.operators import recommend as R
from albumetry.operators.scale import global_rank, lookup_join
from albumetry.session import written

BLOCK = 1024


def hash_population(items: DataFrame) -> DataFrame:
    h = F.col("p_hash")
    return items.agg(
        F.count("*").alias("assets"),
        F.count_if(h.isNotNull() & (h != "")).alias("with_hash"),
        F.count_if(F.coalesce(h.rlike(VALID_HASH), F.lit(False))).alias("valid_hash"),
    )


def distance_bucket(d: Column) -> Column:
    return (
        F.when(d == 0, "0").when(d <= 4, "1-4").when(d <= 10, "5-10").when(d <= 20, "11-20")
        .when(d <= 32, "21-32").otherwise(">32")
    )


def hamming_histogram(items: DataFrame, pairs: int = 1_000, seed: int = 42) -> DataFrame:
    """Distances of ``pairs`` seeded random pairs of different assets, by bucket.

    Every asset gets a seeded random key. The 2·pairs smallest keys are a random
    sample without repeats, taken as neighbours in key order.
    """
    coded = items.withColumn("code", hash_bits(F.col("p_hash"))).filter("code is not null")
    key = F.xxhash64(F.lit(seed), "asset_id")
    sample = coded.select(key.alias("k"), "asset_id", "code").orderBy("k", "asset_id").limit(2 * pairs)
    numbered = sample.agg(F.sort_array(F.collect_list(F.struct("k", "asset_id", "code"))).alias("s")).select(
        F.posexplode("s").alias("at", "r")
    )  # at most 2·pairs rows by the limit above
    paired = numbered.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(
        F.count("*").alias("n"), F.min("r.code").alias("x"), F.max("r.code").alias("y")
    ).filter("n = 2")
    return paired.groupBy(distance_bucket(bit_distance(F.col("x"), F.col("y"))).alias("bucket")).agg(
        F.count("*").alias("pairs")
    )


def edit_pair_distances(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distances of all pairs that share a base name, by bucket.

    Equal hashes are folded to one row with a count. The distinct hashes of a
    name are cut into blocks; two blocks meet in one task, which emits counts
    only, so a name used by a large share of the library is spread over tasks
    and no pair is ever written.
    """
    coded = items.select(base_name(F.col("filename")).alias("base"), hash_bits(F.col("p_hash")).alias("code")).filter("code is not null")
    folded = written(coded.groupBy("base", "code").agg(F.count("*").alias("n")))
    same = folded.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs")).select(
        F.lit("0").alias("bucket"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs")
    )
    sizes = folded.groupBy("base").agg(F.count("*").alias("codes")).filter("codes > 1").withColumn(
        "blocks", F.ceil(F.col("codes") / block).cast("int")
    )
    placed = written(lookup_join(folded, sizes, "base", "code", count="codes", how="inner"))
    # names of one block: joined in place, pairs go straight into the partial counts
    small = placed.filter("blocks = 1")
    x = small.select("base", F.col("code").alias("x"), F.col("n").alias("nx"))
    y = small.select("base", F.col("code").alias("y"), F.col("n").alias("ny"))
    near = x.join(y, "base").filter("x < y").groupBy(bit_distance(F.col("x"), F.col("y")).alias("distance")).agg(
        F.sum(F.col("nx") * F.col("ny")).alias("pairs")
    )
    # larger names: every row meets each block of its name once
    large = placed.filter("blocks > 1").withColumn("at", F.pmod(F.xxhash64("code"), "blocks").cast("int"))
    meets = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"low": F.least("at", "other"), "high": F.greatest("at", "other")}
    )

    def count_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        codes = pdf["code"].to_numpy(np.int64).view(np.uint64)
        n = pdf["n"].to_numpy(np.int64)
        left = np.flatnonzero(pdf["at"].to_numpy() == low)
        right = np.flatnonzero(pdf["at"].to_numpy() == high)
        total = np.zeros(65, dtype=np.int64)
        for i in left:
            js = right[right > i] if low == high else right
            d = np.bitwise_count(codes[i] ^ codes[js])
            np.add.at(total, d, n[i] * n[js])
        return pd.DataFrame({"distance": np.arange(65), "pairs": total}).query("pairs > 0")

    far = meets.select("base", "low", "high", "at", "code", "n").groupBy("base", "low", "high").applyInPandas(
        count_pairs, "distance int, pairs long"
    ).unionByName(near)
    d = F.col("distance")
    bucket = F.when(d == 0, "0").when(d <= 4, "1-4").when(d <= 15, "5-15").otherwise(">15")
    return same.unionByName(far.select(bucket.alias("bucket"), "pairs")).groupBy("bucket").agg(
        F.sum("pairs").alias("pairs")
    ).filter("pairs > 0")


def cross_image_pairs(items: DataFrame) -> DataFrame:
    """Hashes 1 to 4 apart and how many item pairs under them differ in base name.

    One row per pair of hashes: item pairs are counted, not listed, as one hash
    may belong to very many items.
    """
    coded = items.select(base_name(F.col("filename")).alias("base"), hash_bits(F.col("p_hash")).alias("code")).filter("code is not null")
    folded = written(coded.groupBy("code", "base").agg(F.count("*").alias("n")))
    codes = written(folded.groupBy("code").agg(F.sum("n").alias("items"), F.count("*").alias("bases")))
    found = P.hash_pairs(codes, vocab.NEAR_RADIUS)
    left = codes.select(F.col("code").alias("code_a"), F.col("items").alias("items_a"), F.col("bases").alias("bases_a"))
    right = codes.select(F.col("code").alias("code_b"), F.col("items").alias("items_b"), F.col("bases").alias("bases_b"))
    both = written(found.join(left, "code_a").join(right, "code_b"))
    # shared base names are looked up from the hash that has fewer of them
    swap = F.col("bases_b") < F.col("bases_a")
    few = F.when(swap, F.col("code_b")).otherwise(F.col("code_a"))
    many = F.when(swap, F.col("code_a")).otherwise(F.col("code_b"))
    x = folded.select(F.col("code").alias("few"), "base", F.col("n").alias("nx"))
    y = folded.select(F.col("code").alias("many"), "base", F.col("n").alias("ny"))
    same = (
        both.select("code_a", "code_b", few.alias("few"), many.alias("many"))
        .join(x, "few").join(y, ["many", "base"])
        .groupBy("code_a", "code_b").agg(F.sum(F.col("nx") * F.col("ny")).alias("same_base"))
    )
    pairs = F.col("items_a") * F.col("items_b") - F.coalesce("same_base", F.lit(0))
    return (
        both.join(same, ["code_a", "code_b"], "left")
        .select("code_a", "code_b", "distance", "items_a", "items_b", pairs.alias("cross_pairs"))
        .filter("cross_pairs > 0")
    )


def null_rates(records: DataFrame) -> DataFrame:
    none = lambda c: F.count_if(F.coalesce(F.col(c) == "", F.lit(True)))
    bare = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) <= 0)
    return records.agg(
        F.count("*").alias("records"), none("caption").alias("empty_caption"), bare("objects").alias("empty_objects"),
        none("scene").alias("empty_scene"), bare("keyword_keys").alias("empty_keywords"),
    )


def tag_coverage(items: DataFrame, words: list[str]) -> DataFrame:
    """Per word: assets with it in objects, caption or keywords, and file names
    that say it while no tag does."""
    has = lambda c, w: F.coalesce(F.exists(c, lambda x: F.lower(x).contains(w)), F.lit(False))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    checks = []
    for w in words:
        obj, cap, key = has("objects", w), low("caption").contains(w), has("keyword_keys", w)
        tagged = obj | cap | key
        checks.append(
            F.struct(
                F.lit(w).alias("word"), F.count_if(obj).alias("in_objects"), F.count_if(cap).alias("in_caption"),
                F.count_if(key).alias("in_keywords"), F.count_if(tagged).alias("tagged"),
                F.count_if(low("filename").contains(w) & ~tagged).alias("name_only"),
            ).alias(f"c_{len(checks)}")
        )
    one = items.agg(*checks)
    return one.select(F.explode(F.array(*[F.col(f"c_{i}") for i in range(len(words))])).alias("c")).select("c.*")


# --- the recommendation funnel -----------------------------------------------------------

def _pairs_seen(ranked: DataFrame) -> DataFrame:
    """Pairs a list scan compares: for every item, the earlier items that led or
    stood alone and had not been passed by the item's own leader.

    ranked: id, leader_id (null = alone). Works on positions among the items
    that were never taken, so nothing is paired.
    """
    ranked = written(ranked)
    free = ranked.filter("leader_id is null or leader_id = id")
    placed = written(global_rank(free, F.col("ord"), name="place"))
    lead = placed.select(F.col("id").alias("leader_id"), F.col("place").cast("long").alias("lead_place"))
    taken = ranked.filter("leader_id <> id").select("leader_id").groupBy("leader_id").agg(F.count("*").alias("n"))
    a = placed.agg(F.coalesce(F.sum(F.col("place") - 1), F.lit(0)).alias("pairs"))
    b = taken.join(lead, "leader_id").agg(F.coalesce(F.sum(F.col("n") * F.col("lead_place")), F.lit(0)).alias("pairs"))
    return a.unionByName(b).agg(F.sum("pairs").cast("long").alias("pairs"))


def _funnel_rows(category: str, counts: dict[str, DataFrame]) -> DataFrame:
    """One row per stage from one-row aggregates."""
    rows = [
        df.select(F.lit(category).alias("category"), F.lit(stage).alias("stage"), F.col(df.columns[0]).cast("long").alias("pairs"))
        for stage, df in counts.items()
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def _reached(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs the scan really compares: left never taken, right not taken before it."""
    place = ranked.select("id", F.coalesce("leader_id", "id").alias("leader_id"))
    order = ranked.select(F.col("id").alias("leader_id"), F.col("ord").alias("leader_ord"))
    side = place.join(order, "leader_id")
    left = side.filter("leader_id = id").select(F.col("id").alias("a_id"))
    right = side.select(F.col("id").alias("b_id"), F.col("leader_id").alias("b_leader"), "leader_ord")
    return pairs.join(left, "a_id", "left_semi").join(right, "b_id").filter(
        (F.col("b_leader") == F.col("b_id")) | (F.col("leader_ord") >= F.col("a_ord"))
    )


def group_funnel(items: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Pairs compared → within the hash radius → rules passed → groups, for
    exact, near and similar grouping. ``details`` as in ``near_pairs``."""
    details = items if details is None else details
    base = written(G.copy_items(items))
    exact = written(R.exact_groups(items))

    def ranked(rows: DataFrame, grouped: DataFrame) -> DataFrame:
        return written(rows.select("id", "ord").join(grouped, "id", "left"))

    def tally(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("pairs"))

    def taken(grouped: DataFrame) -> DataFrame:
        return tally(grouped.filter("id <> leader_id"))

    def group_count(grouped: DataFrame) -> DataFrame:
        return grouped.agg(F.count_if(F.col("id") == F.col("leader_id")).alias("pairs"))

    all_rows = ranked(base, exact)
    out = _funnel_rows("exact", {
        "compared": _pairs_seen(all_rows), "matched": taken(exact), "accepted": taken(exact), "groups": group_count(exact),
    })
    rest = base.join(exact.select("id"), "id", "left_anti")
    close = written(R.with_details(P.near_items(rest, vocab.NEAR_RADIUS), details, P.NEAR_COLUMNS))
    near = written(G.leader_groups(close.filter(P.near_valid())))
    near_rows = ranked(rest, near)
    out = out.unionByName(_funnel_rows("near", {
        "compared": _pairs_seen(near_rows), "matched": tally(_reached(close.select("a_id", "a_ord", "b_id"), near_rows)),
        "accepted": taken(near), "groups": group_count(near),
    }))
    rest = rest.join(near.select("id"), "id", "left_anti")
    far = written(P.near_items(rest, vocab.SIMILAR_RADIUS))
    judged = P.similar_verdict(R.with_details(far, details, P.SIMILAR_COLUMNS)).filter("is_similar")
    similar = written(G.leader_groups(judged))
    similar_rows = ranked(rest, similar)
    return out.unionByName(_funnel_rows("similar", {
        "compared": _pairs_seen(similar_rows), "matched": tally(_reached(far.select("a_id", "a_ord", "b_id"), similar_rows)),
        "accepted": taken(similar), "groups": group_count(similar),
    }))


def class_funnel(items: DataFrame) -> DataFrame:
    """Per class of single items: how many pass each signal and in the end."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    kind, text = low("document_type"), low("detected_text")
    doc_type = (kind != "") & ~kind.isin("screenshot", "receipt", *vocab.NOT_A_DOCUMENT_TYPE)
    rec_text = F.lit(False)
    for w in vocab.RECEIPT_WORDS:
        rec_text = rec_text | text.contains(w)
    stages = {
        ("documents", "type"): doc_type,
        ("documents", "text"): F.length(text) > 120,
        ("documents", "returned"): doc_type | (F.length(text) > 120),
        ("receipts", "type"): kind == "receipt",
        ("receipts", "text"): rec_text,
        ("receipts", "returned"): (kind == "receipt") | rec_text,
        ("ids", "returned"): R.is_id_item(audit=True),
        ("screenshots", "filename"): low("filename").contains("screenshot"),
        ("screenshots", "caption"): low("caption").contains("screenshot"),
        ("screenshots", "type"): kind == "screenshot",
        ("screenshots", "returned"): R.is_screenshot_item(),
    }
    one = items.agg(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(s).alias("stage"), F.count_if(hit).alias("items")).alias(f"s{i}")
            for i, ((c, s), hit) in enumerate(stages.items())
        ]
    )
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(stages))])).alias("s")).select("s.*")
