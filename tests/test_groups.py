"""Hamming pairs and leader grouping against plain sequential loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from albumetry.operators import groups, pairs


def dist(a, b):
    return (a ^ b).bit_count()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def clustered(rng, n, flips, centres=12):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def brute(codes, radius):
    return {
        tuple(sorted((signed(a), signed(b)))) + (dist(a, b),)
        for i, a in enumerate(codes) for b in codes[i + 1:] if dist(a, b) <= radius
    }


@pytest.mark.parametrize("radius,bucket_rows", [(4, 4096), (8, 4096), (4, 20), (8, 60)])
def test_hash_pairs_equal_all_pairs(spark, radius, bucket_rows):
    rng = random.Random(radius)
    codes = clustered(rng, 400, 6)
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    got = [tuple(r) for r in pairs.hash_pairs(df, radius, bucket_rows=bucket_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(codes, radius)


def test_hot_band_is_split_not_dropped(spark):
    """A third of the hashes share their upper 44 bits."""
    rng = random.Random(3)
    top = rng.getrandbits(44) << 20
    codes = sorted({top | rng.getrandbits(20) for _ in range(200)} | {rng.getrandbits(64) for _ in range(400)})
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    got = [tuple(r) for r in pairs.hash_pairs(df, 4, bucket_rows=30).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(codes, 4)


def test_more_bands_for_more_hashes():
    few = pairs.band_plan(list(range(64)), 4, 1_000)
    many = pairs.band_plan(list(range(64)), 4, 10**9)
    assert len(few) == 5 and len(many) > len(few)
    assert min(m.bit_count() for m, _ in many) >= 24


def scan(n, matches):
    """The list scan: first unvisited leads and takes later unvisited matches."""
    visited, out = set(), {}
    for i in range(n):
        if i in visited:
            continue
        mine = [j for j in range(i + 1, n) if j not in visited and matches(i, j)]
        for j in mine:
            visited.add(j)
            out[j] = i
        if mine:
            visited.add(i)
            out[i] = i
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_groups_equal_list_scan(spark, seed):
    rng = random.Random(seed)
    n = 120
    edge = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.03}
    edge |= {(i, i + 1) for i in range(100, 110)}
    df = spark.createDataFrame(
        [(i, (i, i), j) for i, j in edge], "a_id long, a_ord struct<t:long,i:long>, b_id long"
    )
    got = {r["id"]: r["leader_id"] for r in groups.leader_groups(df).collect()}
    assert got == scan(n, lambda i, j: (i, j) in edge)


def test_a_burst_takes_as_many_rounds_as_blocks(spark):
    """10,000 shots that each resemble the next: the scan pairs them up, in few rounds."""
    n = 10_000
    order = list(range(n))
    random.Random(4).shuffle(order)  # ids are not in list order
    df = spark.createDataFrame([(order[i], (i, i), order[i + 1]) for i in range(n - 1)], "a_id long, a_ord struct<t:long,i:long>, b_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keeps several blocks
    try:
        settled, rounds = groups.settle_rounds(df.repartition(4))
        got = {r["id"]: r["leader_id"] for r in groups.leader_groups(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < rounds <= 8
    assert got == {order[i]: order[i - i % 2] for i in range(n)}


def test_hash_case_does_not_matter(spark):
    rows = [(k, f"{h}", 10, k) for k, h in enumerate(["00ab00ab00ab00ab", "00AB00ab00AB00ab", "00ab00ab00ab00aa"])]
    df = spark.createDataFrame(rows, "asset_id long, p_hash string, file_size long, n long").withColumns(
        {"filename": F.lit("x.jpg"), "taken_at": F.timestamp_seconds("n"), "created_at": F.timestamp_seconds("n")})
    items = groups.copy_items(df)
    assert {(r["leader_id"], r["id"]) for r in groups.copy_groups(items).collect()} == {(1, 1), (1, 0)}


def copies(rng, n, missing):
    rows = []
    for i in range(n):
        code = rng.choice([0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0E, 0x1234567812345678, rng.getrandbits(64)])
        code = None if rng.random() < missing else f"{code:016x}"
        rows.append((i, (i, i), code, f"k{rng.randrange(max(2, n // 8))}"))
    return rows


@pytest.mark.parametrize("radius", [0, 4])
@pytest.mark.parametrize("missing", [0.0, 0.3, 0.9])
def test_copy_groups_equal_list_scan(spark, radius, missing):
    for seed in range(2):
        rows = copies(random.Random(seed), 90, missing)
        df = spark.createDataFrame(rows, "id long, ord struct<t:long,i:long>, p_hash string, fallback string")

        def matches(i, j):
            a, b = rows[i], rows[j]
            if a[2] and b[2]:
                return dist(int(a[2], 16), int(b[2], 16)) <= radius
            return a[3] == b[3]

        got = {r["id"]: r["leader_id"] for r in groups.copy_groups(df, radius).collect()}
        assert got == scan(len(rows), matches)


def test_copy_groups_with_a_hot_hash(spark, monkeypatch):
    """One hash on a third of the rows goes through the salted lookup."""
    from albumetry.operators import scale

    monkeypatch.setattr(groups, "lookup_join",
                        lambda *a, **k: scale.lookup_join(*a, **{**k, "rows_per_task": 50}))
    items = spark.range(600).select(
        "id", F.struct(F.col("id").alias("t"), F.col("id").alias("i")).alias("ord"),
        F.when(F.col("id") % 3 == 0, "00000000000000ff").otherwise(F.lpad(F.hex("id"), 16, "0")).alias("p_hash"),
        F.lit("x").alias("fallback"),
    )
    got = groups.copy_groups(items).collect()
    assert len(got) == 200
    assert {r["leader_id"] for r in got} == {0}


def test_keep_best(spark):
    rows = [
        (1, 1, "dark_a.jpg", 100, 1), (1, 2, "a.jpg", 100, 2), (1, 3, "a (1).jpg", 96, 2),
        (4, 4, "dark_b.jpg", 10, 1), (4, 5, "small_b.jpg", 5, 1),
    ]
    df = spark.createDataFrame(rows, "leader_id long, id long, filename string, file_size long, t long")
    df = df.select("*", F.timestamp_seconds("t").alias("taken_at"),
                   F.struct(F.col("id").alias("t"), F.col("id").alias("i")).alias("ord"))
    got = {r["leader_id"]: r for r in groups.keep_best(df).collect()}
    assert (got[1]["keep_id"], got[1]["score"]) == (2, 55)
    assert got[1]["reasons"] == ["Original (unprocessed)", "Highest resolution"]
    assert (got[4]["keep_id"], got[4]["score"]) == (4, 25)
    saved = {r["leader_id"]: r["savings"] for r in groups.group_savings(df).collect()}
    assert saved == {1: 196, 4: 5}


def test_common_words_of_long_texts(spark):
    """Counts equal a plain loop, and texts of 60,000 words do not meet word by word (3.6 billion tests took minutes)."""
    rng = random.Random(5)
    sides = [([], ["a"]), (["a"], []), (["a", "b", "a", "c"], ["a", "a", "d"]), (["x"], ["y"]), (["é", "é"], ["é"])]
    sides += [([f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))], [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]) for _ in range(50)]
    sides.append(([f"left{i}" for i in range(60_000)] + ["same"] * 3, [f"right{i}" for i in range(60_000)] + ["same"]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sides)], "i int, a array<string>, b array<string>")
    want = {}
    for i, (a, b) in enumerate(sides):
        other = set(b)
        want[i] = (sum(w in other for w in a), len({*a, *b}))
    start = time.time()
    shared = pairs._shared(pairs._counted(F.col("a")), pairs._counted(F.col("b")))
    got = {r["i"]: tuple(r["s"]) for r in df.select("i", shared.alias("s")).collect()}
    assert got == want and time.time() - start < 60


def test_two_crowded_buckets_of_one_path_stay_apart(spark):
    """Pairs across two crowded buckets were found under their own path and once more below the crowded one."""
    rng = random.Random(9)
    codes = set()
    for _ in range(60):
        high = rng.getrandbits(57)
        codes |= {(high ^ 1 << rng.randrange(57)) << 7 | low for low in (0x2A, 0x2B) for _ in range(2)}  # two values of the first band
    codes = sorted(codes)
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    got = [tuple(r) for r in pairs.hash_pairs(df, 8, bucket_rows=40).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(codes, 8)


def test_bands_follow_the_work_of_rows_and_pairs():
    """Very small buckets cost many times the keyed rows: three million codes go by 45 keys, not by 165."""
    assert [len(pairs.band_plan(list(range(64)), 8, n)) for n in (50_000, 3_000_000)] == [9, 45]


def dense(rng, n):
    """Most bits are zero in half of the codes, so that they agree on nearly every band."""
    codes = {sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 7))) & (1 << 64) - 1 for _ in range(n)}
    return sorted(codes | {rng.getrandbits(64) for _ in range(n // 4)} | {0, 1 << 63, (1 << 64) - 1})


@pytest.mark.parametrize("bucket_rows,block_rows", [(4096, 40), (150, 60), (131_072, 32_768)])
def test_large_buckets_are_dealt_out_in_blocks(spark, bucket_rows, block_rows):
    codes = dense(random.Random(12), 500)
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    got = [tuple(r) for r in pairs.hash_pairs(df, 8, bucket_rows=bucket_rows, block_rows=block_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(codes, 8)


def test_three_million_codes_are_dealt_nine_times(spark):
    """A row dealt by Spark costs far more than a pair compared in a task, which parts its buckets by more bands itself."""
    paths = pairs._Paths(spark)
    paths.add(-1, 8, 3_000_000)
    assert len(paths.rows) == 9


def test_tasks_compare_far_fewer_than_all_pairs(monkeypatch):
    """Codes that agree where a pair must differ never meet, and sparse buckets are parted again; the pairs are those of one comparison."""
    import numpy as np

    monkeypatch.setattr(pairs, "RUN_PAIRS", 100)
    monkeypatch.setattr(pairs, "SORTED_PAIRS", 1)
    rng, low, compared = random.Random(5), 0xFF, []
    codes = np.array(dense(rng, 1200), np.uint64)
    spread = np.array(sorted(rng.getrandbits(64) for _ in range(1500)), np.uint64)
    plain = pairs._Near.pairs
    monkeypatch.setattr(pairs._Near, "pairs", lambda self, a, b, d: compared.append(len(a) ** 2 // 2 if b is None else len(a) * len(b)) or plain(self, a, b, d))

    def found(parts):
        listed = [tuple(sorted((int(x), int(y)))) for a, b, _ in parts for x, y in zip(a, b)]
        assert len(listed) == len(set(listed))
        return set(listed)

    for left, right in [(codes, None), (codes[::2], codes[1::2]), (spread, None), (spread[:700], spread[700:])]:
        differ = [low, low << 8] if 0 in left else []
        compared.clear()
        got = found(pairs._Near(8).search(left, right, 0, differ))
        assert got == found(plain(pairs._Near(8), left, right, differ))
        whole = len(left) ** 2 // 2 if right is None else len(left) * len(right)
        assert sum(compared) < 0.7 * whole
