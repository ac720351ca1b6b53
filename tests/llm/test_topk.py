import numpy as np
import pytest

from albumetry.llm import topk


def brute(rows, every, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = np.floor(np.asarray(v, dtype=np.float32).astype(np.float64) * 256).astype(object)
    out = []
    for q in ints:
        if q % every == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block, leaf", [(8192, 512, 256), (40, 3, 4)])
def test_equals_all_pairs(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(topk.build_tree, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, [0.5] * 6) for k in range(60)]  # ties
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6),
             (404, []), (411, [1.0, 2.0]), (420, [3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, shard string")
    got = sorted(map(tuple, topk.top_k(frame, 10, 5, shard=shard, block=block).collect()))
    assert got == brute(rows, 10, 5)
    assert topk.top_k(frame.filter("false"), 10, 5).count() == 0


def test_few_candidates_large_values_and_repeated_rows(spark):
    rows = [(0, [3e5, -2e5]), (1, [1e5, 7e5]), (2, [-4e5, 1.0]), (2, [-4e5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(frame, 50, 5).collect()))
    assert [g[:3] for g in got][:1] == [(0, 1, 1)] and {g[2] for g in got} == {1, 2}
    assert [g for g in got if g[2] == 1] == [r for r in brute(rows, 50, 5) if r[2] == 1]


def test_repeated_query_rows_ask_once(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(60)]
    frame = spark.createDataFrame(rows + rows[:1] * 3, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(frame, 20, 5, shard=20).collect()))
    assert [r for r in got if r[0] == 0] == [r for r in brute(rows, 20, 5) if r[0] == 0]


def test_large_integers_stay_exact():
    ids, v = np.arange(40), np.random.default_rng(1).integers(-(1 << 40), 1 << 40, (40, 3))
    tree = topk.build_tree(ids, v, leaf=4)
    got = topk.search_tree(tree, ids[:1], v[:1], np.array([-np.inf]), np.array([0]), 3)
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(v[0], v[c])), c) for c in range(1, 40)))[:3]
    assert [(s, i) for _, i, s in got] == [(-s, c) for s, c in want]
