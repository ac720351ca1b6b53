"""Repeated passages by bucket-pointer refinement of a sampled suffix array.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere is removed. To find these strings:

1. Sample. Of the q-grams in a window of ``LENGTH`` bytes, the one with the least hash is the window's anchor. Equal
   windows have equal anchors at equal places, so only anchors (about one in 150 positions) stand for suffixes; each
   knows the run of window starts that it is the anchor of.
2. Initial buckets: anchors with the same q-gram. A bucket of one suffix is final: none of its windows occurs twice.
3. Buckets are refined by the identifiers of what lies at the offsets around the anchor (the run's whole extent, as one
   hash). A refined bucket with two suffixes or more is final too: all windows of its runs occur twice. Of it, one
   suffix goes on as a representative, so groups of copies shrink to one row before anything else happens.
4. What is left are suffixes that part somewhere within their run, mostly at the ends of a passage. They fetch the bytes
   around the anchor, and are refined again down to every single offset: two suffixes of a bucket that agree on the
   window at an offset share it. Buckets of up to ``SMALL`` suffixes are sorted in one task, as the method does with
   small buckets; larger ones are refined recursively by the identifiers of ever shorter stretches, as rows.

The same holds for texts taken as sequences of words (``unit="words"``): then lengths, places and windows count words, and
a word stands for itself by the hash of its bytes.

Identifiers are 64-bit hashes of runs. Texts are shuffled only where marks of fixed number say that the document
takes part in step 4 or loses bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from albumetry.llm.shingles import mixed, prefix_hash, run_hash, word_bounds, word_codes
from albumetry.llm.streams import bit_of, bitmap, passes, whole_groups
from albumetry.llm.tables import kept_whole, text_batches, written
from albumetry.operators.scale import ROWS_PER_TASK, lookup_join, maybe_among

LENGTH = 400
GRAM = 100
PART = 1 << 19  # window starts handled at a time, also within one long text
SMALL = 512  # suffixes of a bucket that one task sorts
CELLS = (32, 8, 1)  # offsets refined together in larger buckets, level by level
KEY_BITS = 26  # 8 MB bitmap of repeated q-grams
BYTES, WORDS = "bytes", "words"
CODES = {BYTES: np.dtype(np.uint8), WORDS: np.dtype(np.uint64)}  # what stands for one unit


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from the running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    blocks = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, dtype=values.dtype))).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1: n])


def units_of(texts: Iterable[str | None], unit: str) -> Iterator[np.ndarray]:
    """Each text as an array of its bytes, or of its words' hashes; null is empty."""
    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if unit == BYTES:
            yield np.frombuffer(raw, dtype=np.uint8)
            continue
        if held and size + len(raw) > PART:
            yield from word_codes(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from word_codes(held)


def parts_of(texts: Iterable[np.ndarray], length: int, limit: int = PART) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (row, first unit, units) with about ``limit`` units; long texts are cut so that every window lies in one part."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), limit):
            piece = text[at: at + limit + length - 1]
            if held and size + len(piece) > limit:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def anchors_of(parts: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of the parts: row, pos, lo, hi (first and last window start), key (q-gram), span (extent)."""
    data = np.concatenate([p for _, _, p in parts])
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = run_hash(prefix, at, at + gram)
    least = sliding_min((grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - gram + 1)
    owner = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    counts = sizes - length + 1
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    own = owner[starts]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    lo, hi, pos = starts[first], starts[last], own[first]
    part = np.searchsorted(ends, pos, side="right")
    shift = np.array([a for _, a, _ in parts])[part] - begins[part]
    return {"row": np.array([r for r, _, _ in parts])[part], "pos": pos + shift, "lo": lo + shift, "hi": hi + shift,
            "key": grams[pos].view(np.int64), "span": run_hash(prefix, lo, hi + length).view(np.int64)}


ANCHOR = "key long, span long, cls long, doc_id long, pos int, lo int, hi int, n_units long, crc long"


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_cls": F.xxhash64(text), "_crc": F.crc32(text.cast("binary")), "_n": F.octet_length(text).cast("long")})


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = BYTES) -> DataFrame:
    """One row per anchor, and one row per document with a null key and its size and checksum."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cls, ids = batch["_cls"].to_numpy(), batch["doc_id"]
            sizes: list[int] = []

            def sized(texts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
                for text in texts:
                    sizes.append(len(text))
                    yield text

            for parts in parts_of(sized(units_of(batch["text"], unit)), length):
                found = anchors_of(parts, length, gram)
                row = found.pop("row")
                yield pd.DataFrame(found).assign(cls=cls[row], doc_id=ids.to_numpy()[row], n_units=None, crc=None)[
                    [c.split()[0] for c in ANCHOR.split(", ")]]
            own = pd.DataFrame({"cls": cls, "doc_id": ids, "n_units": sizes, "crc": batch["_crc"]})
            yield own.assign(key=None, span=None, pos=None, lo=None, hi=None)[[c.split()[0] for c in ANCHOR.split(", ")]]

    named = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return named.mapInPandas(find, ANCHOR)


def _suffix(cls="cls", pos="pos"):
    """Number of a suffix: of equal texts, the suffixes at one place are the same."""
    return F.xxhash64(cls, pos)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    """(bucket rows, units around the anchor) of the wanted suffixes, one text fetch per document."""
    reach = length - gram
    per_doc = wanted.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("key", "pos", "lo", "hi", "final", "many")).alias("_all"))
    texts = maybe_among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id")
    texts = _named(texts).select("doc_id", F.col("_cls").alias("_c"), "text")
    met = texts.join(per_doc.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_c") == F.col("cls")))
    kind = "key long, cls long, doc_id long, pos int, lo int, hi int, final boolean, many boolean, before int, units binary"

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, cls, raw, all_ in zip(batch["doc_id"], batch["cls"], units_of(batch["text"], unit), batch["_all"]):
                for r in all_:
                    start = max(0, r["pos"] - reach - CELLS[0])
                    rows.append((r["key"], cls, doc, r["pos"], r["lo"], r["hi"], r["final"], r["many"],
                                 r["pos"] - start, raw[start: r["pos"] + length].tobytes()))
                if len(rows) > 4096:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return met.select("doc_id", "cls", "text", "_all").mapInPandas(fetch, kind)


def _joined(part: pd.DataFrame, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(all units of the contexts, number of each)."""
    raw = part["units"].tolist()
    return np.frombuffer(b"".join(raw), dtype=CODES[unit]), np.array([len(b) // CODES[unit].itemsize for b in raw], dtype=np.int64)


def _windows(part: pd.DataFrame, length: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``part``, offset of the anchor in the window, hash of the window) for every owned window."""
    data, sizes = _joined(part, unit)
    base = np.cumsum(sizes) - sizes
    prefix = prefix_hash(data)
    pos, lo, hi = (part[c].to_numpy().astype(np.int64) for c in ("pos", "lo", "hi"))
    counts = hi - lo + 1
    row = np.repeat(np.arange(len(part)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[row]
    offset = pos[row] - start
    at = base[row] + part["before"].to_numpy().astype(np.int64)[row] - offset
    return row, offset, run_hash(prefix, at, at + length)


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of a row as (row, first byte, end)."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return row[first], start[first], start[last] + length


SPAN = "doc_id long, cls long, start int, end int"


def _sorted_in_tasks(contexts: DataFrame, length: int, unit: str) -> DataFrame:
    """Spans of the small buckets' open suffixes that another suffix of the bucket shares."""
    rows = contexts.repartition("key").sortWithinPartitions("key")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, starts in whole_groups(batches, ["key"]):
            group = np.searchsorted(starts, np.arange(len(part)), side="right")
            # slices of whole buckets, so that memory does not depend on the batch
            bounds = [0, *[int(s) for s, p in zip(starts[1:], starts[:-1]) if s // 2048 != p // 2048], len(part)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                one = part.iloc[a:b].reset_index(drop=True)
                row, offset, window = _windows(one, length, unit)
                ident = mixed(window ^ mixed((group[a:b][row].astype(np.uint64) << np.uint64(16)) | offset.astype(np.uint64)))
                suffix = mixed(one["cls"].to_numpy().astype(np.uint64) ^ mixed(one["pos"].to_numpy().astype(np.uint64)))[row]
                order = np.lexsort((suffix, ident))
                i, s = ident[order], suffix[order]
                new = np.ones(len(i), dtype=bool)
                new[1:] = i[1:] != i[:-1]
                begin = np.flatnonzero(new)
                until = np.append(begin[1:], len(i)) - 1
                twice = np.repeat(s[begin] != s[until], until - begin + 1) if len(i) else np.zeros(0, bool)
                found = np.zeros(len(i), dtype=bool)
                found[order] = twice
                found &= ~one["final"].to_numpy()[row].astype(bool)
                r, start, end = _runs(row[found], (one["pos"].to_numpy()[row] - offset)[found], length)
                yield pd.DataFrame({"doc_id": one["doc_id"].to_numpy()[r], "cls": one["cls"].to_numpy()[r], "start": start, "end": end})

    return rows.mapInPandas(sort, SPAN)


def _cells(part: pd.DataFrame, row: np.ndarray, cell: np.ndarray, width: int, length: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, extent, known) of cells of ``width`` offsets from ``cell`` on: hashes of what all windows of the cell share
    and of all that they cover, the latter where the text goes that far."""
    data, sizes = _joined(part, unit)
    base = (np.cumsum(sizes) - sizes)[row]
    prefix = prefix_hash(data)
    at = part["before"].to_numpy().astype(np.int64)[row] - cell
    first, last = at - width + 1, at + length
    known = (first >= 0) & (last <= sizes[row])
    core = run_hash(prefix, base + at, base + at - width + 1 + length)
    extent = run_hash(prefix, base + np.maximum(first, 0), base + np.minimum(last, sizes[row]))
    here = mixed(part["key"].to_numpy().astype(np.int64).view(np.uint64)[row] ^ mixed(cell.astype(np.uint64)))
    return mixed(core ^ here), mixed(extent ^ here ^ np.uint64(1)), known


LEVEL = ("core long, extent long, cell int, suffix long, doc_id long, cls long, pos int, lo int, hi int, open boolean")


def _level(contexts: DataFrame, width: int, above: int, length: int, unit: str) -> DataFrame:
    """Rows (bucket, cell of offsets, identifiers) of the contexts: all owned cells at the top, else parts of ``_alive``."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                one = batch.iloc[a: a + 2048].reset_index(drop=True)
                low = (one["pos"] - one["hi"]).to_numpy().astype(np.int64)
                high = (one["pos"] - one["lo"]).to_numpy().astype(np.int64)
                if "_alive" in one:
                    held = [(k, r["cell"], r["open"]) for k, cells in enumerate(one["_alive"]) for r in cells]
                    row = np.repeat(np.array([h[0] for h in held], dtype=np.int64), above // width)
                    cell = np.repeat(np.array([h[1] for h in held], dtype=np.int64), above // width)
                    cell += np.tile(np.arange(0, above, width), len(held))
                    is_open = np.repeat(np.array([h[2] for h in held], dtype=bool), above // width)
                else:
                    counts = high // width - low // width + 1
                    row = np.repeat(np.arange(len(one)), counts)
                    cell = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + (low // width)[row]) * width
                    is_open = ~one["final"].to_numpy().astype(bool)[row]
                owned = (cell <= high[row]) & (cell + width > low[row])
                row, cell, is_open = row[owned], cell[owned], is_open[owned]
                core, extent, known = _cells(one, row, cell, width, length, unit)
                out = {c: one[c].to_numpy()[row] for c in ("suffix", "doc_id", "cls", "pos", "lo", "hi")}
                yield pd.DataFrame({"core": core.view(np.int64), "extent": pd.array(extent.view(np.int64), dtype="Int64"),
                                    "cell": cell, **out, "open": is_open}).assign(
                    extent=lambda d: d["extent"].where(known))[[c.split()[0] for c in LEVEL.split(", ")]]

    return contexts.mapInPandas(emit, LEVEL)


def _spread(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", own: tuple[str, ...] = ("doc_id", "cls", "pos")) -> DataFrame:
    """``rows`` met by a table of one row per key and its number ``_n`` of rows; a key with a large share of all rows is dealt out by ``own``."""
    share = min(ROWS_PER_TASK, max(1_000, total // 1_024))  # hence at most 1,024 such keys, or total / ROWS_PER_TASK
    named = rows.withColumn("_own", F.xxhash64(*own))
    return lookup_join(named, table, key, "_own", count="_n", rows_per_task=share, how=how).drop("_own", "_n")


def _refined_by_level(contexts: DataFrame, length: int, unit: str) -> DataFrame:
    """The same for large buckets, from coarse to fine cells of offsets.

    A cell whose extent another suffix shares is done; a cell whose core no other suffix shares holds nothing; the rest
    goes on in smaller cells, with one representative of each finished class beside it. All classes are formed by
    partial sums and met by their count, so no bucket meets in a task.
    """
    contexts = written(contexts.withColumn("suffix", _suffix()))
    spans, alive = [], None
    for width, above in zip(CELLS, (0, *CELLS)):
        here = contexts if alive is None else contexts.join(alive, ["suffix", "lo"])
        rows = written(_level(here, width, above, length, unit))
        total = rows.count()
        shared = rows.filter("extent is not null").groupBy("extent").agg(
            F.min("suffix").alias("_one"), F.max("suffix").alias("_b"), F.count("*").alias("_n"))
        shared = shared.filter("_one <> _b").drop("_b")
        likely = rows.groupBy("core").agg(
            F.min("suffix").alias("_a"), F.max("suffix").alias("_b"), F.bool_or("open").alias("_open"), F.count("*").alias("_n"))
        rows = written(_spread(rows, likely.filter("_a <> _b and _open").select("core", "_n"), "core", total))
        # where the text does not go that far there is no extent to meet by, and a join would put all such rows in one task
        known = _spread(rows.filter("extent is not null"), shared, "extent", total, "left")
        rows = written(known.unionByName(rows.filter("extent is null").withColumn("_one", F.lit(None).cast("long"))))
        found = rows.filter("open and _one is not null")
        # owned windows of the cell: offsets from the larger lower end to the smaller upper end
        first = F.greatest(F.col("lo"), F.col("pos") - F.col("cell") - (width - 1))
        last = F.least(F.col("hi"), F.col("pos") - F.col("cell"))
        spans.append(found.select("doc_id", "cls", first.cast("int").alias("start"), (last + length).cast("int").alias("end")))
        onward = (F.col("open") & F.col("_one").isNull()) | F.col("_one").isNull() | (F.col("suffix") == F.col("_one"))
        alive = rows.filter(onward).withColumn("open", F.col("open") & F.col("_one").isNull())
        alive = alive.groupBy("suffix", "lo").agg(F.collect_list(F.struct("cell", "open")).alias("_alive"))  # within one run
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = BYTES) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): runs of units to remove as (doc_id, cls, start, end); documents whose whole text occurs twice.

    Spans may overlap. Copies, of at least ``length`` units, lose all; spans of theirs are of no account.
    """
    found = written(anchors(docs, length, gram, unit))
    owner = found.filter("key is null").select("doc_id", "cls", F.struct("cls", "crc", "n_units").alias("_whole"))
    many = owner.filter(F.col("_whole.n_units") >= length).groupBy("_whole").agg(F.count("*").alias("_n")).filter("_n > 1")
    copies = _spread(owner.distinct(), many, "_whole", owner.count(), own=("doc_id",))  # repeated rows first become one
    copies = written(copies.select("doc_id", "cls"))

    rows = found.filter("key is not null").drop("n_units", "crc")
    suffix = _suffix()
    # initial buckets: drop those of one suffix, first by bitmap (only bits go to Python), then exactly
    keys = rows.groupBy("key").agg(F.min(suffix).alias("_a"), F.max(suffix).alias("_b"), F.count("*").alias("_n")).filter("_a <> _b").select("key", "_n")
    keys = written(keys)
    total = keys.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys, "key", KEY_BITS))

    @F.pandas_udf(BooleanType())
    def likely(at: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, at.to_numpy()))

    rows = written(_spread(rows.filter(likely(bit_of("key", KEY_BITS))), keys, "key", total))

    # first refinement: the extent of the run around the anchor
    rows = rows.withColumns({"rlo": F.col("pos") - F.col("lo"), "rhi": F.col("hi") - F.col("pos")})
    rows = rows.withColumn("extent", F.xxhash64("key", "rlo", "rhi", "span"))
    buckets = rows.groupBy("extent").agg(
        (F.min(suffix) != F.max(suffix)).alias("final"), F.count("*").alias("_n"), F.first("key").alias("key"), F.first("rlo").alias("rlo"),
        F.first("rhi").alias("rhi"), F.first("cls").alias("cls"), F.first("doc_id").alias("doc_id"), F.first("pos").alias("pos"))
    buckets = written(buckets.withColumns({"lo": F.col("pos") - F.col("rlo"), "hi": F.col("pos") + F.col("rhi")}))
    whole = _spread(rows, buckets.filter("final").select("extent", "_n"), "extent", total).select(
        "doc_id", "cls", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

    # what parts within its run, with one representative of each final bucket beside it
    open_keys = buckets.groupBy("key").agg(F.count("*").alias("_n"), F.bool_or(~F.col("final")).alias("_open")).filter("_open")
    open_keys = open_keys.select("key", "_n", (F.col("_n") > SMALL).alias("many"))
    wanted = _spread(buckets.drop("_n"), open_keys, "key", total)
    wanted = written(wanted.select("key", "cls", "doc_id", "pos", "lo", "hi", "final", "many"))
    contexts = written(_contexts(docs, wanted, length, gram, unit))
    edges = _sorted_in_tasks(contexts.filter("not many"), length, unit).unionByName(_refined_by_level(contexts.filter("many"), length, unit))
    return whole.unionByName(edges), copies


def _merged(spans, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans, given as start * 2^32 + end."""
    out: list[list[int]] = []
    for code in np.sort(np.asarray(spans, dtype=np.int64)).tolist():
        a, b = code >> 32, min(code & 0xFFFFFFFF, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _touched(docs: DataFrame, length: int, gram: int, unit: str = BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents that lose nothing for certain, the others with _copy and _spans), with the columns of ``_named``."""
    spans, copies = repeated_spans(text_batches(docs), length, gram, unit)
    code = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    per = spans.groupBy("doc_id", "cls").agg(F.collect_list(code).alias("_spans"))  # within one text
    per = per.join(copies.select(F.col("doc_id").alias("_d"), F.col("cls").alias("_c"), F.lit(True).alias("_copy")),
                   F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("cls") == F.col("_c")), "full")
    per = written(per.select(F.coalesce("doc_id", "_d").alias("_d"), F.coalesce("cls", "_c").alias("_c"), "_spans",
                             F.coalesce("_copy", F.lit(False)).alias("_copy")))
    # by the marks of the ids, in the JVM: no Python worker stands beside the one that cuts
    named = _named(kept_whole(docs, "doc_id", "text")).withColumn("_id", F.col("doc_id").cast("long"))
    ids = per.select(F.col("_d").alias("_id"))
    met = maybe_among(named, ids, "_id").join(per, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_cls") == F.col("_c")), "left")
    return maybe_among(named, ids, "_id", how="left_anti"), met


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What every document loses and keeps: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else in the table, in the same text or in
    another one, judged on the input. Texts are their UTF-8 bytes; null counts as empty, and texts shorter than
    ``length`` lose nothing. ``text`` is what is left, without what remains of a letter cut in half. Rows that repeat are copies of each other. Null ids are ids like others. Texts of any
    length are taken whole; an empty table gives no rows; other columns are ignored.
    """
    clean, met = _touched(docs.select("doc_id", "text"), length, gram)
    text = F.coalesce(F.col("text"), F.lit(""))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, text string")
    def digest(texts: pd.Series, spans: pd.Series, copy: pd.Series) -> pd.DataFrame:
        import hashlib

        out = []
        for t, s, c in zip(texts, spans, copy):
            raw = t.encode("utf-8", "surrogatepass")
            runs = [(0, len(raw))] if c is True or c is np.True_ else [] if s is None else _merged(s, len(raw))
            left = _cut(raw, runs)
            out.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "text"])

    zero = F.lit(0).cast("long")
    same = clean.select("doc_id", F.col("_n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                        F.sha2(text.cast("binary"), 256).alias("kept_sha256"), text.alias("text"))
    cut = met.withColumn("_d", digest(text, "_spans", F.coalesce("_copy", F.lit(False))))
    return same.unionByName(cut.select("doc_id", F.col("_n").alias("n_bytes"), "_d.n_removed", "_d.n_spans", "_d.kept_sha256", "_d.text"))


def _byte_runs(raw: bytes, runs: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Runs of units as runs of bytes: of words, from the first one's first byte to the last one's end."""
    if unit == BYTES or not runs:
        return runs
    start, end = word_bounds(np.frombuffer(raw, dtype=np.uint8))
    return [(int(start[a]), int(end[b - 1])) for a, b in runs]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: str = BYTES) -> DataFrame:
    """The documents without their repeated passages; columns of ``docs`` (``n_chars``, if there, follows the text).

    Cases as in ``removed``. With ``unit="words"`` a passage is a run of ``length`` words, whatever stands between them, and
    a document's words go from the first one's first byte to the last one's end. Where a run of bytes begins or ends within
    a character, what is left of that character goes too. Documents that lose all stay with an empty text; null texts
    stay null.
    """
    clean, met = _touched(docs, length, gram, unit)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for t, s, c in zip(texts, spans, copy):
            if t is None or (s is None and not c):
                out.append(t)
            else:
                raw = t.encode("utf-8", "surrogatepass")
                runs = [(0, len(raw))] if c else _byte_runs(raw, _merged(s, len(raw)), unit)
                out.append(_cut(raw, runs).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    met = met.withColumn("_text", cut("text", "_spans", F.coalesce("_copy", F.lit(False))))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_spans").isNull() & ~F.coalesce("_copy", F.lit(False)), F.col("row.n_chars")).otherwise(
            F.length("_text").cast(kind))
    return clean.select("row.*").unionByName(met.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
