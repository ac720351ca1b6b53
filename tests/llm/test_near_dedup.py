import random

import numpy as np
import pytest

from albumetry.llm import near_dedup, shingles
from albumetry.llm.components import connected
from tests.llm.helpers import ODD, documents, text_of, words_of


def sets_of(text):
    w = (text or "").encode().lower().translate(None).split()
    if len(w) >= 5:
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute(rows, percent):
    rows = [(d, sets_of(t)) for d, t in rows]
    ids = [d for d, _ in rows]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), d if d is None else find(d)) for d, s in rows}


def corpus():
    rng = random.Random(5)
    rows = list(ODD)
    for k in range(12):
        base = words_of(k, 60 + 20 * k)
        for c in range(6):
            w = list(base)
            for _ in range(c * k // 4):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((100 + 10 * k + c, " ".join(w)))
    rows += [(50 + k, text_of(99, 40)) for k in range(5)]  # equal texts
    rows += [(60, "A  B c\td E"), (61, "a b C d\ne "), (62, text_of(7, 6000)), (63, text_of(7, 5990))]
    common = text_of(1234, 60)
    rows += [(300 + k, common + " " + text_of(5000 + k, 30 + k)) for k in range(40)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_as_by_all_pairs(spark, percent):
    rows = corpus()
    got = near_dedup.near_duplicates(documents(spark, rows), percent / 100).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_blocks_give_the_same(spark, monkeypatch):
    rows = corpus()
    want = brute(rows, 80)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    got = near_dedup.near_duplicates(documents(spark, rows), 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_empty_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(documents(spark, []).filter("false"), 0.8).count() == 0
    twice = documents(spark, [(1, text_of(1, 30)), (1, text_of(1, 30)), (2, text_of(2, 30))])
    assert [r["component_id"] for r in near_dedup.near_duplicates(twice, 0.8).orderBy("doc_id").collect()] == [1, 1, 2]
    kept = near_dedup.one_of_each(twice, 0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert kept.columns == twice.columns


def test_rows_not_ids_are_judged(spark):
    a, b, c, d = (text_of(k, 40) for k in range(11, 15))
    rows = [(2, a), (5, a), (5, b), (7, b), (7, c), (None, a), (None, d), (None, d), (8, None), (8, None), (8, "")]
    kept = near_dedup.one_of_each(documents(spark, rows), 0.8)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(2, a), (5, b), (7, c), (None, d), (8, None), (8, "")], key=repr)


def test_links_by_products_equal_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    a, b = near_dedup._links(sets, None, 0.4)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30)
            if 100 * len(set(sets[i]) & set(sets[j])) >= 40 * len(set(sets[i]) | set(sets[j]))}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_shingle_sets_count_as_tuples():
    texts = ["", " ", "a", "a b c d e", "A b c d e f", "é è", None, "x\x1fy z", text_of(3, 500)]
    for t, s in zip(texts, shingles.shingle_sets(texts)):
        assert len(s) == len(sets_of(t))


def test_long_paths_are_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected(edges.filter("false")).count() == 0
