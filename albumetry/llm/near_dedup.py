"""Near-duplicates by a signature-coordinate inverted join.

1. Every whole text becomes its set of word shingles and a signature of ``COORDINATES`` min-hashes. Texts with equal
   sets are folded to one.
2. A document can be posted under each of its (coordinate, value) pairs. Two documents that match in t of K
   coordinates share a pair among the K - t + 1 first ones of each in any common order of pairs (prefix); the order is
   rarest first, by counts in a table of fixed size, so what many documents share is posted last and skipped.
3. Documents posted under one pair meet in a task, which counts the coordinates they match in, keeps those above t,
   and reports who hangs together, never the pairs. Postings with very many documents are dealt out in blocks.
4. Within each group that hangs together so, links are confirmed on the full sets, again block by block, and only
   what connects is reported. The components of the confirmed links are the result.

t lies so low that a pair at the similarity asked for falls below it about once in 100,000 cases (``Z`` deviations).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetry.llm import shingles
from albumetry.llm.components import connected
from albumetry.llm.streams import bit_of, bitmap, local_labels, passes, whole_groups
from albumetry.llm.tables import kept_whole, text_batches, written

COORDINATES = 64
Z = 4.2
COUNTERS = 1 << 18  # size of the table of pair counts
BLOCK = 1024  # documents of one block
BLOCK_SHINGLES = 1 << 20  # shingles of one block
SMALL = 48  # postings up to this many documents are compared in one go

_rng = np.random.default_rng(20240601)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(similarity: float, k: int = COORDINATES) -> int:
    """Coordinates that two documents must match in."""
    return max(1, math.floor(k * similarity - Z * math.sqrt(k * similarity * (1 - similarity))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes (upper 32 bits) of non-empty sets, one row each."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _ODD[j], starts) >> np.uint64(32)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature, short): set_a and set_b name the set; short keeps the last byte of
    each min-hash; empty sets have neither."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in shingles.chunks(batch["text"].tolist()):
                sets = shingles.shingle_sets(texts)
                full = [k for k, s in enumerate(sets) if len(s)]
                raw = signatures([sets[k] for k in full]) if full else None
                out = pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[first: first + len(texts)].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "set_a": [int(shingles.mixed(s ^ np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                    "set_b": [int(shingles.mixed(s + np.uint64(7)).sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                })
                for name, kind in (("signature", np.uint32), ("short", np.uint8)):
                    values: list = [None] * len(sets)
                    for row, k in enumerate(full):
                        values[k] = raw[row].astype(kind).tobytes()
                    out[name] = pd.Series(values, dtype=object)
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        sign, "doc_id long, n_shingles long, set_a long, set_b long, signature binary, short binary")


def _pairs(raw: pd.Series) -> np.ndarray:
    """(coordinate, value) pairs of each signature as 64-bit numbers."""
    values = np.frombuffer(b"".join(raw), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
    return shingles.mixed(values | (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def pair_counts(folded: DataFrame) -> np.ndarray:
    """How many sets hold each pair, in ``COUNTERS`` shared counters: the size does not depend on the corpus."""
    parts = 16

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            if len(batch):
                at = (_pairs(batch["signature"]) & np.uint64(COUNTERS - 1)).astype(np.int64).ravel()
                total += np.bincount(at, minlength=COUNTERS)
        for k, part in enumerate(np.split(total, parts)):
            if part.any():
                yield pd.DataFrame({"part": [k], "counts": [part.astype(np.uint32 if part.max() < 1 << 32 else np.int64).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"], batch["counts"]):
                total = totals.setdefault(int(part), np.zeros(COUNTERS // parts, dtype=np.int64))
                total += np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * len(total) else np.int64)
        for part, total in totals.items():
            yield pd.DataFrame({"part": [part], "counts": [total.tobytes()]})

    kind = "part int, counts binary"
    sums = folded.select("signature").mapInPandas(count, kind).repartition(parts, "part").mapInPandas(add, kind)
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in sums.collect():  # 16 rows
        out[r["part"] * (COUNTERS // parts): (r["part"] + 1) * (COUNTERS // parts)] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.minimum(out, (1 << 24) - 1).astype(np.uint32)


def postings(folded: DataFrame, counts: np.ndarray, matches: int) -> DataFrame:
    """(pair, doc_id): every set under its K - t + 1 rarest pairs."""
    prefix = COORDINATES - matches + 1
    shared = folded.sparkSession.sparkContext.broadcast(counts)  # 1 MB

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            pairs = _pairs(batch["signature"])
            rarity = shared.value[(pairs & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
            order = (rarity << np.uint64(40)) | (pairs >> np.uint64(24))
            at = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
            yield pd.DataFrame({"pair": np.take_along_axis(pairs, at, axis=1).ravel().view(np.int64),
                                "doc_id": np.repeat(batch["doc_id"].to_numpy(), prefix)})

    return folded.select("doc_id", "signature").mapInPandas(post, "pair long, doc_id long")


def _dealt(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows of a key with ``blocks`` > 1 in every pair of blocks that holds theirs: columns one, two, mine."""
    mine = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col(blocks)).cast("int")
    rows = rows.withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    rows = rows.withColumn("_other", other)
    return rows.withColumn("one", F.least("mine", "_other")).withColumn("two", F.greatest("mine", "_other")).drop("_other", blocks)


def _together(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs a < b inside each run."""
    a, b = [], []
    for m in np.unique(sizes[sizes > 1]):
        x, y = np.triu_indices(m, 1)
        s = starts[sizes == m]
        a.append((s[:, None] + x).ravel())
        b.append((s[:, None] + y).ravel())
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def candidate_groups(folded: DataFrame, posted: DataFrame, matches: int, similarity: float) -> DataFrame:
    """(u, v): documents that hang together by matching in ``matches`` coordinates, as a forest per posting."""
    sizes = posted.groupBy("pair").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")
    short = folded.select("doc_id", "n_shingles", "short")
    rows = posted.join(sizes.select("pair", blocks), "pair").join(short, "doc_id")
    rows = _together(_dealt(rows, "pair", "_blocks"), ["pair", "one", "two"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in whole_groups(batches, ["pair", "one", "two"]):
            ids, n = part["doc_id"].to_numpy(), part["n_shingles"].to_numpy()
            mine, cross = part["mine"].to_numpy(), (part["one"] != part["two"]).to_numpy()
            sig = np.frombuffer(b"".join(part["short"]), dtype=np.uint8).reshape(-1, COORDINATES)
            sizes = np.diff(np.append(starts, len(part)))
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def keep(a: np.ndarray, b: np.ndarray) -> None:
                fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
                fits &= (ids[a] != ids[b]) & ~(cross[a] & (mine[a] == mine[b]))
                a, b = a[fits], b[fits]
                for k in range(0, len(a), 1 << 16):
                    x, y = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
                    good = (sig[x] == sig[y]).sum(axis=1) >= matches
                    found.append((x[good], y[good]))

            small = sizes <= SMALL
            keep(*_pairs_within(starts[small], sizes[small]))
            for s, m in zip(starts[~small], sizes[~small]):
                for k in range(s, s + m - 1):
                    keep(np.full(s + m - 1 - k, k), np.arange(k + 1, s + m))
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
            label = local_labels(len(part), a, b)
            off = label != np.arange(len(part))
            yield pd.DataFrame({"u": ids[off], "v": ids[label[off]]}).drop_duplicates()

    return rows.mapInPandas(compare, "u long, v long").distinct()


def _links(sets: list[np.ndarray], cross: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices a < b with intersection >= similarity * union; with ``cross`` (block of each) only across blocks."""
    n = np.array([len(s) for s in sets])
    m = len(sets)
    if m <= 6:
        a, b = np.triu_indices(m, 1)
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[at] > 1  # a shingle of one document meets nothing
        owner, at = owner[shared], at[shared]
        at = np.unique(at, return_inverse=True)[1]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        total = np.zeros((m, m), dtype=np.float32)
        width = max(256, (1 << 22) // m)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            i, j = np.searchsorted(at, (lo, lo + width))
            dense = np.zeros((m, width), dtype=np.float32)
            dense[owner[i:j], at[i:j] - lo] = 1
            total += dense @ dense.T
        a, b = np.triu_indices(m, 1)
        both = total[a, b].astype(np.int64)
    # similarity as hundredths, so that the boundary is exact
    good = 100 * both >= round(100 * similarity) * (n[a] + n[b] - both)
    if cross is not None:
        good &= cross[a] != cross[b]
    return a[good], b[good]


def confirmed(docs: DataFrame, folded: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(u, v): a forest per pair of blocks of the links whose full sets are similar enough.

    ``groups``: (node, component) of the candidate groups. Only the texts of their nodes are turned into sets and shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(groups, "node"))  # 1 MB

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[passes(bits.value, batch["bit"].to_numpy())]
            for first, texts in shingles.chunks(batch["text"].tolist()):
                found = shingles.shingle_sets(texts)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[first: first + len(texts)].to_numpy(),
                                    "shingles": [s.tobytes() for s in found]})

    members = groups.withColumnRenamed("node", "doc_id").join(folded.select("doc_id", "n_shingles"), "doc_id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("_blocks"))
    members = groups.withColumnRenamed("node", "doc_id").join(sizes, "component")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sets = texts.withColumn("bit", bit_of("doc_id")).mapInPandas(sets_of, "doc_id long, shingles binary")
    rows = _together(_dealt(sets.join(members, "doc_id"), "component", "_blocks"), ["component", "one", "two"])

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in whole_groups(batches, ["component", "one", "two"]):
            out = []
            for s, e in zip(starts, np.append(starts[1:], len(part))):
                one = part.iloc[s:e]
                ids, mine = one["doc_id"].to_numpy(), one["mine"].to_numpy()
                cross = mine if one["one"].iloc[0] != one["two"].iloc[0] else None
                if e - s < 2:
                    continue
                a, b = _links([np.frombuffer(x, dtype=np.uint64) for x in one["shingles"]], cross, similarity)
                label = local_labels(e - s, a, b)
                off = label != np.arange(e - s)
                out.append(pd.DataFrame({"u": ids[off], "v": ids[label[off]]}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Shingle count, component and verdict of every document.

    Documents are linked if 100 * intersection >= 100 * similarity * union of their sets of distinct 5-word shingles
    (words at ASCII white space, A-Z lower-cased; fewer words are one shingle). Returns doc_id, n_shingles, component_id
    (smallest id reachable over links) and kept (doc_id = component_id). Null, empty and wordless texts have no shingle
    and are linked with nothing; equal sets are always linked. Every row is judged by its own text, so repeated rows get equal rows;
    a row without an id is linked with nothing, its component is null and it is kept. Texts of any length are taken
    whole; an empty table gives no rows; other columns are ignored.
    """
    matches = least_matches(similarity)
    docs = text_batches(docs)
    all_rows = written(signed(docs))
    folded = all_rows.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"), F.first("short").alias("short"))
    folded = written(folded)
    posted = postings(folded, pair_counts(folded), matches)
    groups = connected(written(candidate_groups(folded, posted, matches, similarity)))
    links = written(confirmed(docs, folded, groups, similarity))
    found = connected(links)
    members = folded.select("set_a", "set_b", F.col("doc_id").alias("node")).join(found, "node", "left")
    members = members.select("set_a", "set_b", F.coalesce("component", "node").alias("_component"))
    rows = all_rows.drop("signature", "short").join(members, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents of which one stays of each group (that with the smallest id); columns of ``docs``.

    Rows are judged, not ids: rows that share an id or have none are compared like others (equal ones count as copies,
    also without words), and those without an id come last in a group. Other cases as in ``near_duplicates``.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_n"))
    if ids.filter("doc_id is null or _n > 1").limit(1).count():
        # rows are numbered in the order of their ids, and the numbers take the ids' place
        text = F.xxhash64("text", F.col("text").isNull())
        rows = kept_whole(docs, "doc_id", "text").orderBy(F.asc_nulls_last("doc_id"), text)
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
        found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), similarity).filter("kept")
        stays = rows.join(found.select(F.col("doc_id").alias("_row")), "_row", "left_semi")
        first = stays.groupBy("doc_id", text.alias("_text")).agg(F.min("_row").alias("_row"))  # wordless rows that repeat
        return stays.join(first.select("_row"), "_row", "left_semi").select("row.*")
    kept = near_duplicates(docs, similarity).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
