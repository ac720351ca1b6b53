"""Leader grouping, copy groups, keep-best choice and savings.

Groups are kept as rows (leader_id, id), never as arrays, since one group may
hold a large share of the library.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.functions.text import clean_stem, is_original_name
from albumetry.operators.pairs import hash_pairs
from albumetry.functions.hashes import hash_bits
from albumetry.operators.scale import lookup_join
from albumetry.session import written


def list_order(created_at: Column, asset_id: Column) -> Column:
    """Newest first, then id: the order in which groups are formed."""
    return F.struct((-F.unix_micros(created_at)).alias("t"), asset_id.alias("i"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _settled(batches):
    """Decides what a block can decide: (id, leads); edges come in the order of their right item.

    ``state``: 1 the left item leads, 0 it is taken, -1 it was undecided before this round.
    """
    known: dict = {}
    current, led, waits = None, False, False
    for pdf in batches:
        for a, b, state in zip(pdf["a_id"].tolist(), pdf["b_id"].tolist(), pdf["state"].tolist()):
            if b != current:
                if current is not None and (led or not waits):
                    known[current] = not led
                current, led, waits = b, False, False
            if state < 0:
                state = known.get(a, -1)
            led |= state == 1
            waits |= state < 0
    if current is not None and (led or not waits):
        known[current] = not led
    yield pd.DataFrame({"id": list(known), "leads": list(known.values())})


def settle_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """((id, leads) of the items that have earlier and later neighbours or head the list, number of rounds).

    The items are cut into blocks of the list. In every round each block walks its own items in order and settles all
    that do not hang on an undecided item of another block, so chains within a block cost one round, however long, and
    the first open block is settled whole: there are at most as many rounds as blocks.
    """
    id_type = edges.schema["a_id"].dataType.simpleString()
    lefts = edges.select(F.col("a_id").alias("id"), F.col("a_ord").alias("ord")).distinct()
    lefts = written(lefts.repartitionByRange("ord").withColumn("block", F.spark_partition_id()))
    right = lefts.select(F.col("id").alias("b_id"), F.col("ord").alias("b_ord"), "block")
    live = written(edges.select("a_id", "b_id").join(right, "b_id"))
    heads = lefts.join(live.select(F.col("b_id").alias("id")), "id", "left_anti")
    parts = [written(heads.select("id", F.lit(True).alias("leads")))]
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        known = _union(parts).select(F.col("id").alias("a_id"), F.col("leads").cast("int").alias("state"))
        rows = live.join(known, "a_id", "left").select("a_id", "b_id", "b_ord", "block", F.coalesce("state", F.lit(-1)).alias("state"))
        rows = rows.repartition("block").sortWithinPartitions("b_ord", "b_id")
        now = written(rows.mapInPandas(_settled, f"id {id_type}, leads boolean"))
        parts.append(now)
        live = written(live.join(now.select(F.col("id").alias("b_id")), "b_id", "left_anti"))
    return _union(parts), rounds


def taken_items(edges: DataFrame) -> DataFrame:
    """Ids that some earlier leader takes when the list is scanned in order.

    Equals the complement of the lexicographically first maximal independent set. Items without later neighbours decide
    nothing for others: they are taken if any neighbour leads.
    """
    settled, _ = settle_rounds(edges)
    leaders = settled.filter("leads").select(F.col("id").alias("a_id"))
    return edges.join(leaders, "a_id", "left_semi").select(F.col("b_id").alias("id")).distinct()


def leader_groups(edges: DataFrame) -> DataFrame:
    """(leader_id, id) of groups with at least two items, leaders included.

    ``edges``: a_id, a_ord, b_id with a before b. Each taken item joins its
    first adjacent leader.
    """
    edges = written(edges.select("a_id", "a_ord", "b_id"))
    settled, _ = settle_rounds(edges)
    leaders = settled.filter("leads").select(F.col("id").alias("a_id"))
    joined = (
        edges.join(leaders, "a_id", "left_semi")
        .groupBy("b_id").agg(F.min(F.struct("a_ord", "a_id")).alias("first"))
        .select(F.col("first.a_id").alias("leader_id"), F.col("b_id").alias("id"))
    )
    joined = written(joined)
    return joined.unionByName(joined.select("leader_id", F.col("leader_id").alias("id")).distinct())


def copy_items(assets: DataFrame, same_time: bool = True) -> DataFrame:
    """Grouping columns of a catalog: id, ord, p_hash, fallback.

    Items without a hash match on size, time and clean name (or size and full
    name where ``same_time`` is off)."""
    if same_time:
        fallback = F.concat_ws("|", "file_size", F.unix_micros("taken_at"), clean_stem(F.col("filename")))
    else:
        fallback = F.concat_ws("|", "file_size", F.lower("filename"))
    return assets.select(
        F.col("asset_id").alias("id"),
        list_order(F.col("created_at"), F.col("asset_id")).alias("ord"),
        F.when(F.col("p_hash") != "", F.lower("p_hash")).alias("p_hash"),  # digits count, not their case
        fallback.alias("fallback"),
    )


def copy_groups(items: DataFrame, radius: int = 0) -> DataFrame:
    """(leader_id, id): items within ``radius`` of a leader's hash; an item
    without hash matches on its fallback key, as does anything compared to it.
    """
    if items.filter("p_hash is null").isEmpty():
        return _hashed_groups(items, radius)
    return _mixed_groups(items, radius)


def _hashed_groups(items: DataFrame, radius: int) -> DataFrame:
    classes = items.groupBy("p_hash").agg(F.count("*").alias("n"), F.min(F.struct("ord", "id")).alias("head"))
    if radius == 0:
        classes = classes.filter("n > 1").select("p_hash", "n", F.col("head.id").alias("leader_id"))
        return lookup_join(items, classes, "p_hash", "id", how="inner").select("leader_id", "id")
    # items of one hash have the same leader, so hashes are grouped instead of items
    classes = written(classes)
    heads = classes.withColumn("code", hash_bits(F.col("p_hash"))).filter("code is not null")
    edges = _code_edges(hash_pairs(heads, radius), heads)
    led = leader_groups(edges).select(F.col("id").alias("code"), F.col("leader_id").alias("leader_code"))
    names = heads.select(F.col("code").alias("leader_code"), F.col("head.id").alias("leader_id"))
    leaders = heads.select("p_hash", "code").join(led.join(names, "leader_code"), "code")
    table = (
        classes.join(leaders.select("p_hash", "leader_id"), "p_hash", "left")
        .filter("n > 1 or leader_id is not null")
        .select("p_hash", "n", F.coalesce("leader_id", "head.id").alias("leader_id"))
    )
    return _of_two(lookup_join(items, table, "p_hash", "id", how="inner").select("leader_id", "id"))


def _code_edges(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of codes turned so that the earlier first item is on the left."""
    a = heads.select(F.col("code").alias("code_a"), F.col("head.ord").alias("ord_a"))
    b = heads.select(F.col("code").alias("code_b"), F.col("head.ord").alias("ord_b"))
    both = pairs.join(a, "code_a").join(b, "code_b")
    swap = F.col("ord_b") < F.col("ord_a")
    return both.select(
        F.when(swap, F.col("code_b")).otherwise(F.col("code_a")).alias("a_id"),
        F.when(swap, F.col("ord_b")).otherwise(F.col("ord_a")).alias("a_ord"),
        F.when(swap, F.col("code_a")).otherwise(F.col("code_b")).alias("b_id"),
    )


def _of_two(assigned: DataFrame) -> DataFrame:
    """Only groups with at least two rows."""
    assigned = written(assigned)
    sizes = assigned.groupBy("leader_id").agg(F.count("*").alias("n")).filter("n > 1")
    return lookup_join(assigned, sizes, "leader_id", "id", how="inner").select("leader_id", "id")


def _mixed_groups(items: DataFrame, radius: int) -> DataFrame:
    """Grouping when some items have no hash, without listing pairs.

    All items without hash under one fallback key share a leader, and under one
    hash at most one item leads. So only possible leaders are followed: the
    first item without hash per key, and per hash the items up to the first one
    that no item without hash precedes under its key. Rounds work on one row
    per hash and one row per key.
    """
    items = written(items)
    me = F.struct("ord", "id")
    keys = items.groupBy("fallback").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("p_hash").isNull(), me)).alias("u")
    ).filter("u is not null")
    keys = written(keys)
    hashed = lookup_join(items.filter("p_hash is not null"), keys, "fallback", "id").select(
        "id", "ord", "p_hash", "fallback", F.col("u.ord").alias("u_ord")
    )
    free = F.col("u_ord").isNull() | (F.col("u_ord") > F.col("ord"))
    hashed = written(hashed.withColumn("free", free))
    hashes = written(hashed.groupBy("p_hash").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("free"), F.col("ord"))).alias("free_ord")
    ))
    near = _neighbours(hashes, radius)
    possible = lookup_join(hashed, hashes, "p_hash", "id").filter(
        F.col("free_ord").isNull() | (F.col("ord") <= F.col("free_ord"))
    )
    waiting = written(possible.select("id", "ord", "p_hash", "fallback", "u_ord"))
    open_keys = keys.select("fallback", "u")
    anchors: list[DataFrame] = []
    key_leaders: list[DataFrame] = []
    while True:  # every round decides at least the first undecided item
        if waiting.isEmpty() and open_keys.isEmpty():
            break
        first = waiting.groupBy("p_hash").agg(F.min("ord").alias("first"))
        around = near.join(first.withColumnRenamed("p_hash", "other"), "other").groupBy("p_hash").agg(F.min("first").alias("first"))
        undecided = open_keys.select("fallback", F.col("u.ord").alias("open_ord"))
        lead = written(
            waiting.join(around, "p_hash").filter("ord = first").join(undecided, "fallback", "left")
            .filter(F.col("open_ord").isNull() | (F.col("open_ord") > F.col("ord")))
            .select("id", "ord", "p_hash", "fallback")
        )
        anchors.append(lead)
        # a key's first item without hash is taken by an earlier leader, leads, or waits
        earlier = waiting.groupBy("fallback").agg(F.min("ord").alias("wait_ord"))
        led = lead.groupBy("fallback").agg(F.min("ord").alias("lead_ord"))
        state = written(
            open_keys.join(earlier, "fallback", "left").join(led, "fallback", "left").select(
                "fallback", "u",
                F.when(F.col("lead_ord") < F.col("u.ord"), "taken")
                .when(F.col("wait_ord") < F.col("u.ord"), "waits").otherwise("leads").alias("now"),
            )
        )
        leads = state.filter("now = 'leads'").select("fallback", "u")
        key_leaders.append(leads)
        closed = near.join(lead.select("p_hash"), "p_hash").select(F.col("other").alias("p_hash")).distinct()
        waiting = written(
            waiting.join(closed, "p_hash", "left_anti")
            .join(leads, "fallback", "left").filter("u is null or u.ord > ord").drop("u")
        )
        open_keys = state.filter("now = 'waits'").select("fallback", "u")
    lead, key_lead = _union(anchors), _union(key_leaders)
    by_hash = near.join(lead.select(F.col("p_hash").alias("other"), me.alias("led")), "other").groupBy("p_hash").agg(
        F.min("led").alias("by_hash")
    )
    by_key = key_lead.select("fallback", F.col("u").alias("by_key"))
    hash_table = hashes.select("p_hash", "n").join(by_hash, "p_hash", "left")
    of_hashed = lookup_join(
        lookup_join(hashed.drop("u_ord"), hash_table, "p_hash", "id").drop("n"),
        keys.select("fallback", "n").join(by_key, "fallback"), "fallback", "id",
    )
    earlier_key = F.when(F.col("by_key.ord") < F.col("ord"), F.col("by_key"))
    of_hashed = of_hashed.select(F.least("by_hash", earlier_key)["id"].alias("leader_id"), "id")
    first_anchor = lead.join(keys, "fallback").filter("ord < u.ord").groupBy("fallback").agg(F.min(me).alias("by_item"))
    key_table = keys.select("fallback", "n").join(by_key, "fallback", "left").join(first_anchor, "fallback", "left")
    of_missing = lookup_join(items.filter("p_hash is null"), key_table, "fallback", "id").select(
        F.coalesce("by_key.id", "by_item.id").alias("leader_id"), "id"
    )
    return _of_two(of_hashed.unionByName(of_missing))


def _neighbours(hashes: DataFrame, radius: int) -> DataFrame:
    """(p_hash, other) within the radius, each hash being its own neighbour."""
    own = hashes.select("p_hash", F.col("p_hash").alias("other"))
    if radius == 0:
        return own
    coded = written(hashes.select("p_hash", hash_bits(F.col("p_hash")).alias("code")).filter("code is not null"))
    pairs = hash_pairs(coded, radius)
    a = coded.select(F.col("p_hash").alias("p_hash"), F.col("code").alias("code_a"))
    b = coded.select(F.col("p_hash").alias("other"), F.col("code").alias("code_b"))
    named = pairs.join(a, "code_a").join(b, "code_b").select("p_hash", "other")
    turned = named.select(F.col("other").alias("p_hash"), F.col("p_hash").alias("other"))
    return written(own.unionByName(named).unionByName(turned))


# --- per group ----------------------------------------------------------------

def group_members(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """Group rows with the columns that keep-best and savings need."""
    cols = assets.select(
        F.col("asset_id").alias("id"), "filename", "file_size", "taken_at",
        list_order(F.col("created_at"), F.col("asset_id")).alias("ord"),
    )
    return groups.join(cols, "id")


def group_savings(members: DataFrame) -> DataFrame:
    """Per group: items, bytes, and bytes freed when the largest is kept."""
    return members.groupBy("leader_id").agg(
        F.count("*").alias("items"),
        F.sum("file_size").alias("bytes"),
        (F.sum("file_size") - F.max("file_size")).alias("savings"),
    )


def keep_best(members: DataFrame) -> DataFrame:
    """The item to keep per group with its score and reasons."""
    members = written(members)
    stats = members.groupBy("leader_id").agg(
        F.count("*").alias("n"), F.max("file_size").alias("largest"), F.max("taken_at").alias("latest")
    )
    rows = lookup_join(members, stats, "leader_id", "id")
    original = is_original_name(F.col("filename"))
    largest = (F.col("file_size") == F.col("largest")) & (F.col("n") > 1)
    near_largest = ~largest & (F.col("file_size") >= F.col("largest") * 0.95)
    latest = F.coalesce((F.col("taken_at") == F.col("latest")) & (F.col("n") > 1), F.lit(False))
    score = (
        F.when(original, 30).otherwise(0)
        + F.when(largest, 20).when(near_largest, 10).otherwise(0)
        + F.when(latest, 5).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(original, "Original (unprocessed)"),
            F.when(largest, "Highest resolution").when(near_largest, "Near-highest resolution"),
        )
    )
    best = rows.groupBy("leader_id").agg(
        F.min(F.struct((-score).alias("minus"), F.col("ord"), F.col("id"), reasons.alias("reasons"))).alias("best")
    )
    return best.select(
        "leader_id",
        F.col("best.id").alias("keep_id"),
        (-F.col("best.minus")).alias("score"),
        F.when(F.size("best.reasons") == 0, F.array(F.lit("Largest file"))).otherwise(F.col("best.reasons")).alias("reasons"),
    )
