"""Exact nearest vectors for a table of queries, and the vector table itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.functions.text import collection_key
from albumetry.functions.vectors import cosine
from albumetry.operators.scale import keep_newest, upsert
from albumetry.session import written

CELL = 256  # vectors of a cell, on average, while there are pivots enough
MOST_PIVOTS = 4096  # rows that the driver and every task hold, whatever the number of vectors
BLOCK_VECTORS = 8192  # scores that a task holds at once stay below 64 MB
BLOCK_QUERIES = 1024
TILE_NUMBERS = 1 << 21  # of the vectors of one tile: 16 MB; a tile also takes up to 16 times BLOCK_QUERIES queries
TILE_SLICES = 16
EXACT_PAIRS = 1 << 16  # scored again in double precision at once
SLACK = 1e-6  # of angles, for rounding


def _kind(rows: DataFrame) -> str:
    """Type of number in which the vectors of a table travel between tasks."""
    return "float32" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"


def _bytes(rows: pd.Series, kind: str) -> list[bytes]:
    return [np.asarray(r, dtype=kind).tobytes() for r in rows]


def _unit(rows: pd.Series, kind: str | None = None) -> np.ndarray:
    """Unit vectors of arrays, or of bytes in numbers of a kind."""
    m = np.asarray(rows.tolist(), dtype=np.float64) if kind is None else np.frombuffer(b"".join(rows), dtype=kind).astype(np.float64).reshape(len(rows), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


@dataclass(frozen=True)
class Cells:
    """Cells of unit vectors about pivots: what tells from afar whether a cell can hold a vector near enough."""

    pivots: np.ndarray  # one row per cell, nearest neighbours side by side
    size: np.ndarray
    low: np.ndarray  # least and largest angle of a cell's vectors to its pivot
    high: np.ndarray
    block: np.ndarray  # first block of the cell's vectors, and number of blocks they are dealt over
    parts: np.ndarray

    def reached(self, angles: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells (columns) that can hold a vector within the angle ``reach`` of each query (rows), by the triangle inequality."""
        within = reach[:, None] + SLACK
        return (self.size > 0) & (angles - self.high <= within) & (self.low - angles <= within)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _slices(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, BLOCK_VECTORS * BLOCK_QUERIES // max(1, width))
    for at in range(0, len(batch), step):
        yield batch.iloc[at: at + step]


class VectorIndex:
    """Vectors in cells about pivots: ``placed`` (asset_id, vector, cell, block) and what is known of the ``cells``.

    A vector is kept as the bytes of its numbers.

    Pivots are a sample by hash, one per ``CELL`` vectors and at most ``MOST_PIVOTS``; every vector lies in the cell of the pivot
    nearest to it. Cells are dealt into blocks of about ``block`` vectors (``TILE_NUMBERS`` numbers, unless given), near ones together;
    a larger cell takes several blocks.
    """

    def __init__(self, vectors: DataFrame, cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int | None = None):
        vectors = vectors.select("asset_id", "embedding").filter("embedding is not null")
        spark = vectors.sparkSession
        n = max(1, min(most_pivots, -(-vectors.count() // cell)))
        drawn = vectors.orderBy(F.xxhash64("asset_id"), "asset_id").limit(n).toPandas()  # at most most_pivots rows
        pivots = _side_by_side(_unit(drawn["embedding"])) if len(drawn) else np.zeros((1, 1))
        block = block or min(4 * BLOCK_VECTORS, max(CELL, TILE_NUMBERS // max(1, pivots.shape[1])))
        self.kind = numbers = _kind(vectors)
        shared = spark.sparkContext.broadcast(pivots)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in _slices(batch, len(pivots)):
                    angles = _angles(_unit(part["embedding"]), shared.value)
                    cell = angles.argmin(axis=1)
                    yield pd.DataFrame({"asset_id": part["asset_id"].to_numpy(), "vector": _bytes(part["embedding"], numbers),
                                        "cell": cell.astype("int32"), "angle": angles[np.arange(len(part)), cell]})

        name = vectors.schema["asset_id"].dataType.simpleString()
        placed = written(vectors.mapInPandas(place, f"asset_id {name}, vector binary, cell int, angle double"))
        size, low, high = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
            size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
        first, parts, at, held = np.zeros(len(size), dtype=np.int64), np.ones(len(size), dtype=np.int64), 0, 0
        for k, n in enumerate(size.tolist()):
            if held and held + n > block:
                at, held = at + 1, 0
            first[k], parts[k] = at, max(1, -(-n // block))
            if parts[k] > 1:
                at, held = at + int(parts[k]), 0
            else:
                held += n
        self.cells = Cells(pivots, size, low, high, first, parts)
        where = spark.createDataFrame([(k, int(first[k]), int(parts[k])) for k in range(len(size))], "cell int, _first long, _parts long")
        deal = F.col("_first") + F.pmod(F.xxhash64("asset_id"), F.col("_parts"))
        self.placed = placed.join(F.broadcast(where), "cell").select("asset_id", "vector", "cell", deal.alias("block"))


def _side_by_side(pivots: np.ndarray) -> np.ndarray:
    """Pivots in the order of the one among every 32nd that they are nearest to."""
    return pivots[np.argsort(_angles(pivots, pivots[::32]).argmin(axis=1), kind="stable")]


def _out_schema(queries: DataFrame, vectors: DataFrame) -> str:
    q = queries.schema["query_id"].dataType.simpleString()
    a = vectors.schema["asset_id"].dataType.simpleString()
    return f"query_id {q}, asset_id {a}, score double"


def best_k(scored: DataFrame, k: int) -> DataFrame:
    """Ranked best k rows per query; each task keeps k per query before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("asset_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _routed(queries: DataFrame, cells: Cells, numbers: str, home: bool) -> DataFrame:
    """(query_id, vector, least, block, pairs): the block of each query's nearest cell, or all others that it can reach.

    ``pairs`` is the number of vectors to be scored there. Beyond home, queries come with ``least``, the score that a hit must
    have, ``block``, their home, and ``vector``, the bytes of their numbers.
    """
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector binary"

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        share = cells.size / cells.parts
        for batch in batches if cells.size.any() else ():
            for part in _slices(batch, 4 * len(cells.size)):
                angles = _angles(_unit(part["embedding"]) if home else _unit(part["vector"], numbers), cells.pivots)
                vector = np.empty(len(part), dtype=object)
                vector[:] = _bytes(part["embedding"], numbers) if home else part["vector"].tolist()
                if home:
                    nearest = np.where(cells.size > 0, angles, np.inf).argmin(axis=1)
                    row, block = np.arange(len(part)), cells.block[nearest]
                    there = np.bincount(cells.block, weights=share)
                    pairs = there[block]
                else:
                    reach = np.arccos(np.clip(part["least"].to_numpy() - 1e-9, -1.0, 1.0))
                    row, cell = np.nonzero(cells.reached(angles, reach))
                    parts = cells.parts[cell]
                    row, first = np.repeat(row, parts), np.repeat(cells.block[cell], parts)
                    block = first + np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
                    # one row per query and block
                    code, at = np.unique(row * (int(cells.block.max() + cells.parts.max()) + 1) + block, return_inverse=True)
                    pairs = np.bincount(at, weights=np.repeat(share[cell], parts), minlength=len(code))
                    row, block = np.divmod(code, int(cells.block.max() + cells.parts.max()) + 1)
                    away = block != part["block"].to_numpy()[row]
                    row, block, pairs = row[away], block[away], pairs[away]
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "vector": vector[row],
                                    "least": part["least"].to_numpy()[row], "block": block, "pairs": pairs})

    return queries.mapInPandas(route, f"{kind}, least double, block long, pairs double")


def _nearest(asked: np.ndarray, held: np.ndarray, least: np.ndarray, near: tuple[np.ndarray, np.ndarray], k: int, rows: int, width: int) -> Iterator[tuple]:
    """(query, vector, score) of the best k of each query: of scores of at least ``least``, ties to the first vector.

    ``near`` tells by query and vector group which can be left out: a pair of arrays, groups by query and the group of each vector.
    Scores are first taken in single precision, slice by slice; what can be among the best k by its rounding error is scored
    again in double precision.
    """
    reached, group = near
    slack = (asked.shape[1] + 8) * 2.0 ** -22
    a, h = asked.astype(np.float32), held.astype(np.float32)
    for at in range(0, len(asked), rows):
        here = slice(at, at + rows)
        columns = np.flatnonzero(reached[here].any(axis=0)[group])
        exact, low = least[here] - 1e-9, least[here] - slack
        best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for first in range(0, len(columns), width):
            some = columns[first: first + width]
            scores = a[here] @ h[some].T
            parts = len(some) // 64
            if parts >= k:  # k of the slice's parts hold a score as high
                tops = scores[:, :64 * parts].reshape(-1, parts, 64).max(axis=2)
                low = np.maximum(low, np.partition(tops, parts - k, axis=1)[:, parts - k] - 2 * slack)
            row, column = np.nonzero(scores >= low[:, None])
            if not len(row):
                continue
            column = some[column]
            score = np.concatenate([np.round(np.einsum("ij,ij->i", asked[at + row[i: i + EXACT_PAIRS]], held[column[i: i + EXACT_PAIRS]]), 9)
                                    for i in range(0, len(row), EXACT_PAIRS)])
            good = score >= exact[row]
            row, column, score = (np.concatenate([x, y[good]]) for x, y in zip(best, (row, column, score)))
            order = np.lexsort((column, -score, row))
            row, column, score = row[order], column[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            full = place == k - 1
            low[row[full]] = np.maximum(low[row[full]], score[full] - slack)
            best = row[place < k], column[place < k], score[place < k]
        yield at + best[0], best[1], best[2]


def _scored(routed: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(query_id, asset_id, score): best k of each query in each block that it was sent to."""
    shared = routed.sparkSession.sparkContext.broadcast(index.cells)
    numbers, rows, width = index.kind, max(1, BLOCK_QUERIES // 4), BLOCK_VECTORS // 2
    asked = routed.groupBy("block").agg(F.ceil(F.count("*") / (TILE_SLICES * BLOCK_QUERIES)).cast("int").alias("_split"))
    left = routed.join(asked, "block").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_split")).cast("int"))
    right = index.placed.join(asked, "block").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_split") - 1)))

    def tile(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        cells = shared.value
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "asset_id": [], "score": []})
        v = v.sort_values("asset_id", kind="stable")  # columns are in order of asset_id
        there, group = np.unique(v["cell"].to_numpy(), return_inverse=True)
        one = Cells(*[getattr(cells, f.name)[there] for f in fields(Cells)])
        asked, held = _unit(q["vector"], numbers), _unit(v["vector"], numbers)
        angles = _angles(asked, one.pivots)
        reach = np.arccos(np.clip(q["least"].to_numpy() - 1e-9, -1.0, 1.0))
        order = np.argsort(angles.argmin(axis=1), kind="stable")  # slices of queries near each other reach fewer cells
        near = one.reached(angles[order], reach[order]), group
        hits = list(_nearest(asked[order], held, q["least"].to_numpy()[order], near, k, rows, width))
        row, column, score = (np.concatenate(x) for x in zip(*hits))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[order[row]], "asset_id": v["asset_id"].to_numpy()[column], "score": score})

    return left.select("query_id", "vector", "least", "block", "_part").groupBy("block", "_part").cogroup(
        right.groupBy("block", "_part")).applyInPandas(tile, _out_schema(routed, index.placed))


def _searched(queries: DataFrame, index: VectorIndex, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(hits, routes of both rounds)."""
    asked = queries.select("query_id", "embedding").filter("embedding is not null").withColumns({"least": F.lit(float(least)), "block": F.lit(-1).cast("long")})
    home = written(_routed(asked, index.cells, index.kind, home=True))
    near = written(_scored(home, index, k))
    # the k-th score at home is one that a hit must have
    known = best_k(near, k).groupBy("query_id").agg(F.min("score").alias("_score"), F.count("*").alias("_n"))
    least_now = F.when(F.col("_n") == k, F.greatest("least", "_score")).otherwise(F.col("least"))
    onward = home.join(known, "query_id", "left").withColumn("least", least_now).select("query_id", "vector", "least", "block")
    away = written(_routed(onward, index.cells, index.kind, home=False))
    return near.unionByName(_scored(away, index, k)), home.unionByName(away)


def top_k_batch(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, asset_id, score, rank): exact top k by cosine per query, of scores of at least ``least``.

    queries: query_id, embedding; vectors: asset_id, embedding, or an index of them that is used again. Each query first
    meets the block of vectors nearest to it; its k-th score there, or ``least``, then says by the triangle inequality
    which other cells can hold a hit, and only those are scored. Tiles of queries and vectors are of bounded size and emit k
    rows per query. Null vectors take no part; zero vectors score 0.
    """
    index = vectors if isinstance(vectors, VectorIndex) else VectorIndex(vectors)
    hits, _ = _searched(queries, index, k, least)
    return best_k(hits, k)


def pairs_scored(queries: DataFrame, index: VectorIndex, k: int, least: float = -1.0) -> float:
    """Number of (query, vector) pairs that ``top_k_batch`` scores."""
    return _searched(queries, index, k, least)[1].agg(F.sum("pairs")).first()[0] or 0.0


def top_k(vectors: DataFrame, query: Column, k: int, offset: int = 0) -> DataFrame:
    """Best k assets for one query vector (a literal array column)."""
    return (
        vectors.select("asset_id", cosine(F.col("embedding"), query).alias("score"))
        .orderBy(F.col("score").desc(), "asset_id").offset(offset).limit(k)
    )


def similar_assets(sources: DataFrame, vectors: DataFrame, assets: DataFrame, limit: int = 20,
                   least: float = 0.8) -> DataFrame:
    """Similar assets of every active source: (source_id, asset_id, score, percentage).

    Deleted assets are removed after the cut, so fewer than ``limit`` may remain.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    active = assets.filter(~F.col("is_deleted")).select("asset_id")
    wanted = sources.join(active, "asset_id", "left_semi").select("asset_id")
    queries = wanted.join(vectors, "asset_id").select(F.col("asset_id").alias("query_id"), "embedding")
    hits = top_k_batch(queries, vectors, limit + 1, least).filter(
        (F.col("asset_id") != F.col("query_id")) & (F.col("score") >= least)
    )
    return (
        best_k(hits.drop("rank"), limit)
        .join(active, "asset_id", "left_semi")
        .select(F.col("query_id").alias("source_id"), "asset_id", "score", (F.col("score") * 100).alias("percentage"))
    )


# --- the vector table ------------------------------------------------------------

def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those of the same asset and model."""
    return upsert(old, new, ["asset_id", "model_name"])


def vector_register(vectors: DataFrame) -> DataFrame:
    """(asset, model) with the vector length, once each."""
    rows = vectors.select("asset_id", "model_name", F.size("embedding").alias("vector_dimension"))
    return keep_newest(rows, ["asset_id", "model_name"], F.col("vector_dimension").desc())


def write_vectors(vectors: DataFrame, path: str) -> None:
    """One folder per model."""
    vectors.withColumn("model_key", collection_key(F.col("model_name"))).write.mode("overwrite").partitionBy(
        "model_key"
    ).parquet(path)


def delete_vectors(vectors: DataFrame, ids: DataFrame, model: str | None = None) -> DataFrame:
    """Vectors left after removing the ids (of one model, or of all)."""
    gone = ids.select("asset_id").withColumn("_gone", F.lit(True)).distinct()
    hit = F.coalesce(F.col("_gone"), F.lit(False))
    if model is not None:
        hit = hit & (F.col("model_name") == model)
    return vectors.join(gone, "asset_id", "left").filter(~hit).drop("_gone")


def index_payload(assets: DataFrame) -> DataFrame:
    return assets.select(
        "asset_id",
        F.struct(
            F.col("asset_id").cast("string").alias("id"), "filename",
            F.unix_timestamp(F.coalesce("taken_at", F.current_timestamp())).alias("taken_at"),
        ).alias("payload"),
    )


def prompt_aesthetics(vectors: DataFrame, prompts: DataFrame, tau: float) -> DataFrame:
    """Mean antonym-pair softmax per asset: (asset_id, aesthetic).

    ``prompts``: pair, positive, negative (unit vectors); a handful of rows, joined
    as one array per asset.
    """
    from albumetry.functions.vectors import dot, pair_probability

    pairs = prompts.agg(F.sort_array(F.collect_list(F.struct("pair", "positive", "negative"))).alias("pairs"))
    shares = F.transform(
        "pairs",
        lambda p: pair_probability(dot(F.col("embedding"), p["positive"]), dot(F.col("embedding"), p["negative"]), tau),
    )
    mean = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x) / F.size("pairs")
    # one row: the fixed prompt set
    return vectors.join(F.broadcast(pairs)).select("asset_id", mean.alias("aesthetic"))


def label_scores(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Best label per asset with its softmax share: (asset_id, label, probability).

    ``labels``: label_no, label, embedding; a fixed small vocabulary of prompts.
    """
    from albumetry.functions.vectors import dot

    table = labels.agg(F.sort_array(F.collect_list(F.struct("label_no", "label", F.col("embedding").alias("e")))).alias("labels"))
    scored = vectors.join(F.broadcast(table)).select(
        "asset_id",
        F.transform(
            "labels",
            lambda x: F.struct(dot(F.col("embedding"), x["e"]).alias("s"), (-x["label_no"]).alias("first"), x["label"].alias("label")),
        ).alias("scores"),
    )
    best = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"]))
    return scored.select(
        "asset_id", best["label"].alias("label"), (F.exp(best["s"]) / total).alias("probability")
    )
