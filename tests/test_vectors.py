"""Pruned vector search against all scores."""

import numpy as np
import pytest

from albumetry.operators import vectors as V


def clustered(rng, n, clusters=40, spread=0.05, d=16):
    centres = rng.normal(size=(clusters, d))
    return centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, d))


def brute(queries, vectors, k, least=-1.0):
    def unit(m):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    ids = np.array([i for i, _ in vectors])
    scores = np.round(unit(np.array([q for _, q in queries])) @ unit(np.array([v for _, v in vectors])).T, 9)
    out = {}
    for (query, _), row in zip(queries, scores):
        best = sorted(((-s, i) for s, i in zip(row.tolist(), ids.tolist()) if s >= least))[:k]
        out.update({(query, i, r + 1): -s for r, (s, i) in enumerate(best)})
    return out


def frame(spark, rows, name):
    return spark.createDataFrame([(i, v if v is None else list(map(float, v))) for i, v in rows], f"{name} long, embedding array<double>")


def close(got, want):
    got = {(r["query_id"], r["asset_id"], r["rank"]): r["score"] for r in got.collect()}
    return got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


@pytest.mark.parametrize("cell, pivots, block", [(V.CELL, V.MOST_PIVOTS, V.BLOCK_VECTORS), (10, 64, 50), (5, 4, 7), (1, 4096, 1)])
@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_top_k_equals_all_scores(spark, monkeypatch, cell, pivots, block, kind):
    monkeypatch.setattr(V, "BLOCK_QUERIES", 9)  # tiles are cut on the driver
    rng = np.random.default_rng(5)
    m = clustered(rng, 400) if kind == "clusters" else rng.normal(size=(400, 16))
    rows = list(enumerate(m)) + [(1000 + k, m[3]) for k in range(30)] + [(2000, np.zeros(16)), (2001, -m[3])]  # copies, zero, opposite
    queries = [(k, v) for k, v in rows if k % 5 == 0 or k >= 1995]
    index = V.VectorIndex(frame(spark, [*rows, (3000, None)], "asset_id"), cell, pivots, block)
    asked = frame(spark, [*queries, (3001, None)], "query_id")
    assert close(V.top_k_batch(asked, index, 6), brute(queries, rows, 6))
    assert close(V.top_k_batch(asked, index, 50, least=0.8), brute(queries, rows, 50, 0.8))


def test_few_pairs_are_scored_on_clusters(spark):
    rng = np.random.default_rng(6)
    rows = list(enumerate(clustered(rng, 6000, clusters=300)))
    v = frame(spark, rows, "asset_id")
    index = V.VectorIndex(v, cell=20, block=200)
    asked = v.filter("asset_id % 4 = 0").withColumnRenamed("asset_id", "query_id")
    assert V.pairs_scored(asked, index, 5, 0.8) < 0.1 * 1500 * 6000
    assert close(V.top_k_batch(asked, index, 5, 0.8), brute([r for r in rows if r[0] % 4 == 0], rows, 5, 0.8))


def test_empty_sides(spark):
    v = frame(spark, [(1, [1, 0]), (2, [0, 1])], "asset_id")
    q = v.withColumnRenamed("asset_id", "query_id")
    assert V.top_k_batch(q.filter("false"), v, 3).count() == 0
    assert V.top_k_batch(q, v.filter("false"), 3).count() == 0
    assert V.top_k_batch(q, v, 3).count() == 4


def test_tiles_are_bounded():
    assert V.BLOCK_QUERIES * V.BLOCK_VECTORS * 8 <= 64 << 20


def test_vectors_travel_in_few_large_tiles(spark):
    """A vector is sent once per 16,384 queries of a block, as the bytes of its numbers; copies and near ties come out exactly."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 64)).astype("float32")
    rows = [(k, base[k % 40] + (1e-6 * (k % 3) if k % 2 else 0)) for k in range(3000)]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "asset_id long, embedding array<float>")
    index = V.VectorIndex(v)
    assert dict(index.placed.dtypes)["vector"] == "binary" and index.cells.parts.max() == 1 and index.cells.block.max() == 0
    asked = v.filter("asset_id % 50 = 0").withColumnRenamed("asset_id", "query_id")
    single = [(i, x.astype("float32").astype("float64")) for i, x in rows]
    assert close(V.top_k_batch(asked, index, 7, 0.25), brute([r for r in single if r[0] % 50 == 0], single, 7, 0.25))
    plan = V._searched(asked, index, 7, 0.25)[0]._jdf.queryExecution().toString()
    assert f"/ {float(16 * V.BLOCK_QUERIES)}" in plan
