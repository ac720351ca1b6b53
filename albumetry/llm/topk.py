"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

The catalog is dealt into shards of about ``SHARD`` vectors by the hash of the id; each becomes one row holding a ball
tree. Queries come in blocks. First every block searches one shard, which gives each query a kth score; then the block
and these scores go to all other shards, which skip every ball whose upper bound (query . centre + |query| * radius)
cannot beat them. Blocks and trees meet by an equi-join on the shard, one pair per row, so a task holds one tree and
one block at a time. At most k rows per query leave a shard.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from albumetry.llm.tables import written

SHARD = 8192
BLOCK = 512
LEAF = 256
EXACT = 2.0**52  # sums of products below this are exact in double


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in vectors])


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Ball tree over integer vectors: rows in leaf order, and per node its rows, children, ball and smallest id."""
    order = np.lexsort((ids,))
    values = vectors.astype(np.float64)
    lows, highs, left, centres, radii, smallest = [], [], [], [], [], []

    def add(lo: int, hi: int) -> int:
        rows = values[order[lo:hi]]
        centre = rows.mean(axis=0)
        lows.append(lo)
        highs.append(hi)
        left.append(-1)
        centres.append(centre)
        radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) if hi > lo else 0.0)
        smallest.append(ids[order[lo:hi]].min())
        return len(lows) - 1

    todo = [add(0, len(ids))]
    while todo:
        node = todo.pop()
        lo, hi = lows[node], highs[node]
        if hi - lo <= leaf:
            continue
        rows = values[order[lo:hi]]
        far = rows[((rows - centres[node]) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        along = rows @ (other - far)
        order[lo:hi] = order[lo:hi][np.lexsort((ids[order[lo:hi]], along))]
        middle = (lo + hi) // 2
        left[node] = add(lo, middle)
        todo += [left[node], add(middle, hi)]  # the right child follows the left one
    return {"ids": ids[order], "vectors": vectors[order], "lo": np.array(lows), "hi": np.array(highs), "left": np.array(left),
            "centre": np.array(centres), "radius": np.array(radii), "smallest": np.array(smallest)}


def search_tree(tree: dict, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int):
    """Per query at most ``k`` (query, id, score) that beat its kth (score, id), best first; the query's own id is left out."""
    vectors = tree["vectors"]
    dims = max(1, vectors.shape[1])
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims < EXACT
    kind = np.float64 if exact else object
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    if exact:
        length = np.sqrt((queries**2).sum(axis=1))
        reach = length[:, None] * (np.sqrt((tree["centre"] ** 2).sum(axis=1)) + tree["radius"])[None, :]
        bound = queries @ tree["centre"].T + length[:, None] * tree["radius"][None, :]
        bound = np.floor(bound + 1e-9 * reach + 1e-6)  # scores are whole numbers
    else:
        bound = np.full((len(queries), len(tree["lo"])), np.inf)
    found = []
    for q in range(len(queries)):
        best: list[tuple] = []  # the k best so far, worst first: (score, -id)
        floor = (kth[q], -kth_id[q])
        upper = bound[q]
        heap = [(-upper[0], tree["smallest"][0], 0)]
        while heap:
            most, first, node = heapq.heappop(heap)
            least = best[0] if len(best) == k else floor
            if (-most, -first) <= least:
                if -most < least[0]:
                    break  # no later ball reaches higher
                continue
            if tree["left"][node] >= 0:
                for child in (tree["left"][node], tree["left"][node] + 1):
                    heapq.heappush(heap, (-upper[child], tree["smallest"][child], int(child)))
                continue
            lo, hi = tree["lo"][node], tree["hi"][node]
            scores, ids = vectors[lo:hi] @ queries[q], tree["ids"][lo:hi]
            for at in np.flatnonzero(scores >= least[0]):
                one = (int(scores[at]), -int(ids[at]))
                if ids[at] == qids[q] or one <= floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        found += [(int(qids[q]), -i, s) for s, i in sorted(best, reverse=True)]
    return found


def as_integers(embedding: Column) -> Column:
    """floor(256 x) of every component; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return F.when(fine, whole)


def _pack(rows: DataFrame, keys: list[str], tree: bool) -> DataFrame:
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = part["vec_id"].to_numpy(np.int64), _matrix(part["vector"])
        raw = _dump(**build_tree(ids, vectors)) if tree else _dump(ids=ids, vectors=vectors)
        return pd.DataFrame([[int(x) for x in key] + [raw]], columns=[*keys, "raw"])

    return rows.groupBy(*keys).applyInPandas(pack, ", ".join(f"{x} int" for x in keys) + ", raw binary")


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Searches each row's tree for the row's block; ``kth`` holds the scores to beat, if any."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, block, kth in zip(batch["tree"], batch["raw"], batch["kth"]):
                q = _load(block)
                least = _load(kth) if kth is not None else {
                    "score": np.full(len(q["ids"]), -np.inf), "id": np.zeros(len(q["ids"]))}
                got = search_tree(_load(tree), q["ids"], q["vectors"], least["score"], least["id"], k)
                yield pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    return pairs.select("tree", "raw", "kth").mapInPandas(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest inner products of every query (ids divisible by ``every``) among all other rows, exactly.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Vectors become integers floor(256 x).
    Null vectors, null ids and vectors with a null or non-finite component take no part; vectors meet those of
    their own length only. An id names a vector: rows that repeat the query's id count as its own, other repeated rows
    count once each; of a query id's rows the least vector is asked for. Fewer than k candidates give fewer rows; an empty table gives none. Scores are exact while they
    fit a long. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding")).alias("vector"))
    rows = written(rows.filter("vec_id is not null and vector is not null").withColumn("dims", F.size("vector")))
    shards = max(1, -(-rows.count() // shard))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = written(queries.withColumn("dims", F.size("vector")))
    blocks = max(1, -(-queries.count() // block))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = written(_pack(dealt, ["dims", "shard"], True).withColumnRenamed("raw", "tree"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = written(_pack(asked, ["dims", "block"], False))
    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("binary")
    first = written(_searched(asked.withColumn("shard", home).withColumn("kth", none).join(trees, ["dims", "shard"]), k))

    # the kth score of each query, block by block, for all other shards
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("_score"), F.col("vec_id").alias("_id"))
    known = queries.select("vec_id", "dims").join(kth, "vec_id").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    known = known.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "_score", "_id")).alias("_known"))  # a block

    def lined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, pairs in zip(batch["raw"], batch["_known"]):
                at = {r["vec_id"]: r for r in pairs} if pairs is not None else {}
                ids = _load(raw)["ids"].tolist()
                out.append(_dump(score=np.array([at[i]["_score"] if i in at else -np.inf for i in ids], dtype=np.float64),
                                 id=np.array([at[i]["_id"] if i in at else 0 for i in ids], dtype=np.int64)))
            yield batch[["dims", "block", "raw"]].assign(kth=out)

    shared = asked.join(known, ["dims", "block"], "left").mapInPandas(lined_up, "dims int, block int, raw binary, kth binary")
    others = shared.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
    rest = _searched(others.join(trees, ["dims", "shard"]), k)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
