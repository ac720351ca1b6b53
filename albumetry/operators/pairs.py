"""Pairs of 64-bit hashes within a Hamming radius, exactly.

Bits are cut into m bands. Two hashes within radius r agree on at least m - r
of them, so they meet under some combination of m - r bands. A pair is kept
only under the first combination it agrees on, so no distinct is needed. Keys
that collect too many hashes are split again on their remaining bits by the
same rule. Large buckets below that are dealt out block by block; a task gets
whole blocks of codes, parts them by bands once more where that saves work, and
compares them as arrays.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import text as X
from albumetry.functions.hashes import bit_distance, hash_bits
from albumetry.functions.text import let
from albumetry.session import written

BUCKET_ROWS = 131_072  # buckets with more codes are split again
BLOCK_ROWS = 32_768  # buckets with more codes are dealt out block by block
TASK_ROWS = 65_536
SLICE_PAIRS = 1 << 16  # pairs compared at once: they stay in the cache
BATCH_PAIRS = 1 << 16
MOST_KEYS = 512
ROW_PAIRS = 150  # pairs that can be checked in the time that one more keyed row takes to be dealt and sorted
DEALT_PAIRS = 4096  # the same where tasks part their buckets again
SORTED_PAIRS, RUN_PAIRS = 50, 10_000  # the same for a code sorted and for a run begun within a task


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _split(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` near-equal runs of the given bit positions."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in itertools.pairwise(edges)]


def band_plan(bits: list[int], radius: int, hashes: int, row_pairs: int = ROW_PAIRS) -> list[tuple[int, list[int]]]:
    """(mask, bands that must differ) per combination, for about ``hashes`` rows.

    Takes the bands with the least work: a row per hash and key, and the pairs of a key's buckets. More bands make smaller
    buckets but many times the keys, so buckets of some hundreds are cheaper than very small ones.
    """
    best, least = None, math.inf
    for m in range(radius + 1, len(bits) + 1):
        agree = m - radius
        keys = math.comb(m, agree)
        if best is not None and (keys > MOST_KEYS or keys >= least):
            break
        bands = _split(bits, m)
        shortest = sum(sorted(b.bit_count() for b in bands)[:agree])
        work = keys * (1 + hashes / 2 ** shortest / 2 / row_pairs)
        if work < least:
            best, least = (bands, agree), work
    if best is None:  # fewer bits than bands: one bucket, every pair is checked
        return [(0, [])]
    bands, agree = best
    plan = []
    for combo in itertools.combinations(range(len(bands)), agree):
        differ = [bands[i] for i in range(combo[-1]) if i not in combo]
        plan.append((sum(bands[i] for i in combo), differ))
    return plan


class _Paths:
    """Numbered band combinations with their parents, kept on the driver.

    There are at most a few thousand, whatever the data."""

    def __init__(self, spark):
        self.spark = spark
        self.rows: list[tuple[int, int, int, list[int]]] = []
        self.fixed: dict[int, int] = {-1: 0}
        self.differ: dict[int, list[int]] = {-1: []}

    def add(self, parent: int, radius: int, hashes: int) -> None:
        free = [b for b in range(64) if not self.fixed[parent] >> b & 1]
        for mask, differ in band_plan(free, radius, hashes, DEALT_PAIRS):
            path = len(self.rows)
            self.fixed[path] = self.fixed[parent] | mask
            self.differ[path] = self.differ[parent] + differ
            # the key holds the parent's bits too: two crowded buckets of one path must not meet
            self.rows.append((path, parent, self.fixed[path], [_signed(d) for d in self.differ[path]]))

    def table(self, first: int) -> DataFrame:
        rows = [(p, q, _signed(m), d) for p, q, m, d in self.rows[first:]]
        return self.spark.createDataFrame(rows, "path int, parent int, mask long, differ array<long>")


def hash_pairs(hashes: DataFrame, radius: int, code: str = "code", bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs of distinct codes at distance 1..radius: (code_a < code_b, distance).

    ``hashes`` must hold distinct 64-bit codes. The result is a written table.
    """
    spark = hashes.sparkSession
    codes = written(hashes.select(F.col(code).alias("code")))
    total = codes.count()
    paths = _Paths(spark)
    paths.add(-1, radius, total)
    rows, dealt = codes.withColumn("parent", F.lit(-1)), total * len(paths.rows)
    first, found = 0, []
    while True:
        table = paths.table(first)
        # bounded: one row per band combination, never per hash
        keyed = rows.join(F.broadcast(table.select("path", "parent", "mask")), "parent").select(
            "path", F.col("code").bitwiseAND(F.col("mask")).alias("slot"), "code"
        )
        splittable = [p for p in range(first, len(paths.rows)) if paths.fixed[p].bit_count() <= 64 - radius - 1
                      and 2 ** (64 - paths.fixed[p].bit_count()) > bucket_rows]
        n, again = F.col("n"), F.col("path").isin(splittable) & (F.col("n") > bucket_rows)
        crowded = keyed.groupBy("path", "slot").agg(F.count("*").alias("n")).filter(again | (n > block_rows))
        crowded = written(crowded.select("path", "slot", "n", again.alias("again"), F.ceil(n / block_rows).cast("int").alias("blocks")))
        # one row per band combination at most
        sizes = crowded.groupBy("path").agg(
            F.max(F.when(F.col("again"), n)).alias("n"), F.coalesce(F.sum(F.when(F.col("again"), n)), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(~F.col("again"), n * (F.col("blocks") - 1))), F.lit(0)).alias("copies")).collect()
        # counted rows: at most one crowded bucket per that many keyed rows
        marked = keyed.join(F.broadcast(crowded), ["path", "slot"], "left")
        cold = marked.filter(~F.coalesce("again", F.lit(False))).select("path", "slot", "code", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        dealt += sum(r["copies"] - r["rows"] for r in sizes)
        found.append(written(_verified(cold, {p: (m, d) for p, _, m, d in paths.rows[first:]}, radius, 1 + dealt // TASK_ROWS)))
        sizes = [r for r in sizes if r["n"]]
        if not sizes:
            break
        rows = written(marked.filter("again").select("code", F.col("path").alias("parent"), "slot"))
        first, dealt = len(paths.rows), 0
        for r in sizes:
            before = len(paths.rows)
            paths.add(r["path"], radius, r["n"])
            dealt += r["rows"] * (len(paths.rows) - before)
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _verified(keyed: DataFrame, paths: dict[int, tuple[int, list[int]]], radius: int, tasks: int) -> DataFrame:
    """Pairs of a bucket, each block of it with each; blocks by the hash of the code. ``paths``: mask and masks that must differ."""
    own = F.expr("cast(pmod(xxhash64(code), blocks) as int)")
    met = keyed.select("path", "slot", "code", own.alias("own"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tile = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tagged = met.select((F.shiftleft(F.col("path").cast("long"), 40) + 4 * tile + side).alias("tag"), "slot", "code")
    dealt = tagged.repartition(tasks, F.shiftright("tag", 2), "slot").select("tag", "code")
    return dealt.mapInArrow(_compared(paths, radius), "code_a long, code_b long, distance int")


def _compared(paths: dict[int, tuple[int, list[int]]], radius: int) -> Callable:
    """Compares the codes of one task, bucket by bucket; a task has about ``TASK_ROWS`` rows, and its pairs leave in batches."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        tag, code = (c.to_numpy() for c in pa.Table.from_batches(batches).columns)
        path, code = tag >> 40, code.view(np.uint64)
        slot = code & np.array([paths.get(p, (0,))[0] for p in range(int(path.max()) + 1)], np.uint64)[path]
        order = np.lexsort((tag, slot))
        tag, slot, code = tag[order], slot[order], code[order]
        edges = np.flatnonzero((slot[1:] != slot[:-1]) | (tag[1:] >> 2 != tag[:-1] >> 2)) + 1
        near, out, ready = _Near(radius), [], 0
        for lo, hi in itertools.pairwise([0, *edges.tolist(), len(code)]):
            mask, differ = paths[int(tag[lo] >> 40)]
            sides = tag[lo:hi] & 3
            cut = lo + int(np.searchsorted(sides, 2))
            found = near.search(code[lo:cut], None if sides[0] == 0 else code[cut:hi], mask, [m & (1 << 64) - 1 for m in differ])
            for part in found:
                out.append(part)
                ready += len(part[0])
                if ready >= BATCH_PAIRS:
                    yield _batch(out)
                    out, ready = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    arrays = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["code_a", "code_b", "distance"])


class _Near:
    """Pairs of arrays of distinct codes within a radius. ``right`` None: pairs within ``left``."""

    def __init__(self, radius: int):
        self.radius = radius
        self._room(SLICE_PAIRS)

    def _room(self, size: int) -> None:
        size = -(-size // 8) * 8
        self.apart, self.bits, self.near = np.empty(size, np.uint64), np.empty(size, np.uint8), np.zeros(size, bool)

    def search(self, left: np.ndarray, right: np.ndarray | None, fixed: int, differ: list[int], part: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """``pairs``, without the codes that agree on a band that must differ, and by bands of the bits that are not ``fixed``,
        where either is less work for these very codes."""
        whole = len(left) * (len(left) - 1) // 2 if right is None else len(left) * len(right)
        if whole > SORTED_PAIRS * RUN_PAIRS:
            saved, mask, value = max((_agreeing(left, right, m) for m in differ), default=(0, 0, 0))
            if saved > whole // 8:
                same = left & np.uint64(mask) == value
                more = [m for m in differ if m != mask]
                if right is None:
                    yield from self.search(left[same], left[~same], fixed, more, part)
                else:
                    equal = right & np.uint64(mask) == value
                    yield from self.search(left[same], right[~equal], fixed, more, part)
                    yield from self.search(left[~same], right[equal], fixed, more, part)
                    right = right[~equal]
                yield from self.search(left[~same], right, fixed, differ, part)
                return
            if part:
                codes = len(left) + (0 if right is None else len(right))
                plan = band_plan([b for b in range(64) if not fixed >> b & 1], self.radius, codes)
                runs = [_runs(left, right, m) for m, _ in plan]
                work = sum(RUN_PAIRS + (len(a) * len(a) // 2 if b is None else len(a) * len(b)) for r in runs for a, b in r)
                if work + len(plan) * codes * SORTED_PAIRS < whole:
                    for (_, more), r in zip(plan, runs, strict=True):
                        for a, b in r:
                            yield from self.search(a, b, fixed, differ + more, False)
                    return
        yield from self.pairs(left, right, differ)

    def pairs(self, left: np.ndarray, right: np.ndarray | None, differ: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        """Slice by slice: (one code, the other, distance) of the pairs that differ under every mask of ``differ``."""
        at, masks = 0, [np.uint64(m) for m in differ]
        while at < len(left):
            others = left[at:] if right is None else right
            if not len(others):
                return
            block = left[at : at + max(1, SLICE_PAIRS // len(others))]
            at += len(block)
            size = len(block) * len(others)
            if size > len(self.apart):
                self._room(size)
            apart, whole = self.apart[:size], -(-size // 8) * 8
            np.bitwise_xor(block[:, None], others[None, :], out=apart.reshape(len(block), len(others)))
            bits = np.bitwise_count(apart, out=self.bits[:size])
            np.subtract(bits, 1, out=bits)  # a code and itself: 255
            if not np.less(bits, self.radius, out=self.near[:size]).any():
                continue
            self.near[size:whole] = False
            eights = np.flatnonzero(self.near[:whole].view(np.uint64))  # few, as a rule
            if 16 * len(eights) > whole // 8:
                hit = np.flatnonzero(self.near[:size])
            else:
                hit = (eights[:, None] * 8 + np.arange(8)).ravel()
                hit = hit[self.near[hit]]
            differing = apart[hit]
            for mask in masks:  # kept under the first combination only
                if not len(hit):
                    break
                kept = (differing & mask) != 0
                hit, differing = hit[kept], differing[kept]
            if not len(hit):
                continue
            one, other = np.divmod(hit, len(others))
            if right is None:
                kept = other > one
                hit, one, other = hit[kept], one[kept], other[kept]
            if len(hit):
                yield block[one].view(np.int64), others[other].view(np.int64), bits[hit] + 1


def _agreeing(left: np.ndarray, right: np.ndarray | None, mask: int) -> tuple[int, int, int]:
    """(pairs that agree under a mask on its most frequent value, the mask, the value)."""
    values, counts = np.unique(left & np.uint64(mask), return_counts=True)
    most = int(counts.argmax())
    value, n = int(values[most]), int(counts[most])
    other = n - 1 if right is None else 2 * int(np.count_nonzero(right & np.uint64(mask) == values[most]))
    return n * other // 2, mask, value


def _runs(left: np.ndarray, right: np.ndarray | None, mask: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Arrays of codes that agree under a mask and can hold a pair."""

    def sort(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        slots = codes & np.uint64(mask)
        order = np.argsort(slots)
        slots = slots[order]
        starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        return codes[order], slots[starts], [*starts.tolist(), len(codes)]

    codes, slots, edges = sort(left)
    if right is None:
        return [(codes[a:b], None) for a, b in itertools.pairwise(edges) if b - a > 1]
    others, theirs, ends = sort(right)
    _, i, j = np.intersect1d(slots, theirs, assume_unique=True, return_indices=True)
    return [(codes[edges[a] : edges[a + 1]], others[ends[b] : ends[b + 1]]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def near_items(items: DataFrame, radius: int, distinct: bool = False) -> DataFrame:
    """Pairs of items at distance 1..radius, earlier item on the left.

    ``items`` needs id, ord (total order) and p_hash, and no two items with the
    same hash (exact copies are grouped before); missing hashes take no part.
    """
    coded = items.withColumn("code", hash_bits(F.col("p_hash"))).filter(F.col("code").isNotNull())
    coded = written(coded.select("id", "ord", "code"))
    pairs = hash_pairs(coded, radius)
    left = coded.select(F.col("id").alias("id_a"), F.col("ord").alias("ord_a"), F.col("code").alias("code_a"))
    right = coded.select(F.col("id").alias("id_b"), F.col("ord").alias("ord_b"), F.col("code").alias("code_b"))
    joined = pairs.join(left, "code_a").join(right, "code_b")
    swap = F.col("ord_b") < F.col("ord_a")

    def pick(x: str, y: str) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    return joined.select(
        pick("id_a", "id_b").alias("a_id"), pick("ord_a", "ord_b").alias("a_ord"),
        pick("id_b", "id_a").alias("b_id"), pick("ord_b", "ord_a").alias("b_ord"),
        "distance",
    )


# --- rules on a joined pair; left is the earlier item --------------------------

def _lowered(c: Column) -> Column:
    return X.strip(F.lower(c))


def scene_compatible(left: Column, right: Column) -> Column:
    """Order matters: the two sides know different words."""
    a, b = _lowered(left), _lowered(right)
    beach_a, beach_b = X.contains_any(a, vocab.BEACH_LEFT), X.contains_any(b, vocab.BEACH_RIGHT)
    hills = X.contains_any(a, vocab.MOUNTAIN_LEFT) & X.contains_any(b, vocab.MOUNTAIN_RIGHT)
    clash = (beach_a & X.contains_any(b, vocab.INDOOR_RIGHT)) | (X.contains_any(a, vocab.INDOOR_LEFT) & beach_b)
    missing = left.isNull() | right.isNull() | (left == "") | (right == "")
    return missing | F.coalesce((a == b) | (beach_a & beach_b) | hills | ~clash, F.lit(True))


def aspect_compatible(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    ratio = F.try_divide(wa.cast("double"), ha.cast("double"))
    direct = F.abs(ratio - F.try_divide(wb.cast("double"), hb.cast("double"))) <= 0.40
    turned = F.abs(ratio - F.try_divide(hb.cast("double"), wb.cast("double"))) <= 0.40
    usable = (wa != 0) & (ha != 0) & (wb != 0) & (hb != 0)
    return F.when(usable, direct | turned).otherwise(True)


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def _counted(words: Column) -> Column:
    """Map of each word to its number of occurrences; by a sort, so that long texts cost little more than their words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        sizes = lambda at: F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(s)) - i)
        return let(starts, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), sizes(at)))

    none = F.create_map().cast("map<string,int>")
    return F.when(F.size(words) == 0, none).otherwise(let(F.sort_array(words), runs))


def with_rule_words(records: DataFrame, keep_metric_keys: bool = False) -> DataFrame:
    """Per record word lists and counts used by the pair rules, computed once before pairing."""
    none = X.empty_words()
    objects = F.coalesce(F.col("objects"), none)
    caption = X.meaningful_words(F.col("caption"))
    keys = F.filter(F.coalesce(F.col("keyword_keys"), none), X.is_meaningful)
    if not keep_metric_keys:
        keys = F.filter(keys, lambda k: ~k.isin(vocab.METRIC_KEYS))
    return records.withColumns(
        {
            "near_objects": F.filter(F.transform(objects, _lowered), X.is_meaningful),
            "similar_objects": F.filter(objects, X.is_meaningful),
            "caption_words": caption,
            "colour_words": F.transform(F.coalesce(F.col("dominant_colors"), none), _lowered),
            "word_counts": let(F.concat(caption, keys), _counted),
            "text_counts": let(X.meaningful_words(F.col("detected_text")), _counted),
        }
    )


# what the rules read of each side of a pair, and no more: a pair carries it twice
NEAR_COLUMNS = ["width", "height", "scene", "near_objects", "caption_words", "colour_words"]
SIMILAR_COLUMNS = ["scene", "similar_objects", "word_counts", "text_counts", "document_type", "people_count", "event_type", "taken_at"]


def attach_sides(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """Adds a_* and b_* columns of both items; details has one row per id."""
    cols = [c for c in details.columns if c != "id"]
    left = details.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = details.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.join(left, "a_id").join(right, "b_id")


def _all_mono(colours: Column) -> Column:
    return F.forall(colours, lambda c: X.contains_any(c, vocab.MONOCHROME))


def near_rules() -> dict[str, tuple[Column, Column]]:
    """rule → (applies, passes) on a pair with both sides attached."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    sized = F.coalesce((a("width") != 0) & (a("height") != 0) & (b("width") != 0) & (b("height") != 0), F.lit(False))
    scenes = F.coalesce((_lowered(a("scene")) != "") & (_lowered(b("scene")) != ""), F.lit(False))
    objects = (F.size(a("near_objects")) > 0) & (F.size(b("near_objects")) > 0)
    captions = (F.size(a("caption_words")) >= 3) & (F.size(b("caption_words")) >= 3)
    colours = (F.size(a("colour_words")) >= 2) & (F.size(b("colour_words")) >= 2)
    return {
        "aspect": (sized, aspect_compatible(a("width"), a("height"), b("width"), b("height"))),
        "scene": (scenes, scene_compatible(a("scene"), b("scene"))),
        "objects": (objects, overlap(a("near_objects"), b("near_objects"))),
        "caption": (captions, overlap(a("caption_words"), b("caption_words"))),
        "colours": (
            colours,
            overlap(a("colour_words"), b("colour_words")) | _all_mono(a("colour_words")) | _all_mono(b("colour_words")),
        ),
    }


def near_valid() -> Column:
    ok = F.lit(True)
    for applies, passes in near_rules().values():
        ok = ok & (~applies | passes)
    return ok


def rule_trace(pairs: DataFrame) -> DataFrame:
    """Per rule PASSED, SKIPPED or REJECTED, and the decision."""
    out = pairs
    for name, (applies, passes) in near_rules().items():
        out = out.withColumn(
            f"{name}_rule", F.when(~applies, "SKIPPED").when(passes, "PASSED").otherwise("REJECTED")
        )
    return out.withColumn("decision", F.when(near_valid(), "ACCEPTED").otherwise("REJECTED"))


def _shared(a: Column, b: Column) -> Column:
    """struct(common, words): occurrences in ``a`` of words that ``b`` has, and distinct words of both; from counted words.

    Both maps are met by hash: a test of every word against every other grows with the square of the texts.
    """
    both = F.map_zip_with(a, b, lambda _, x, y: F.when(y.isNotNull(), F.coalesce(x, F.lit(0))).otherwise(0))
    summed = lambda counts: F.aggregate(counts, F.lit(0), lambda n, x: n + x)
    return let(F.map_values(both), lambda v: F.struct(summed(v).alias("common"), F.size(v).alias("words")))


def similar_verdict(pairs: DataFrame) -> DataFrame:
    """Adds consistency, confidence, reasons, explanation and is_similar."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    d = F.col("distance")
    visual = F.when(d == 0, 100).when(d <= 2, 95).when(d <= 4, 90).when(d <= 6, 85).otherwise(80)
    none = X.empty_words()

    doc_a, doc_b = (F.coalesce(_lowered(c), F.lit("")) for c in (a("document_type"), b("document_type")))
    both_docs = (doc_a != "") & (doc_b != "")
    doc_clash = both_docs & (doc_a != doc_b) & (doc_a != "other") & (doc_b != "other")
    scene_ok = scene_compatible(a("scene"), b("scene"))

    obj_a, obj_b = a("similar_objects"), b("similar_objects")
    obj_known = (F.size(obj_a) > 0) & (F.size(obj_b) > 0)
    obj_common = F.get(F.array_intersect(obj_a, obj_b), F.lit(0))  # the first of a's that b has
    obj_score = F.when(~obj_known, 0.5).when(obj_common.isNotNull(), 1.0).otherwise(0.1)

    scenes = F.coalesce((a("scene") != "") & (b("scene") != ""), F.lit(False))
    scene_score = F.when(~scenes, 0.5).when(scene_ok, 1.0).otherwise(0.2)

    def word_score(shared: Column) -> Column:
        common = shared["common"]
        return F.when(common / shared["words"] >= 0.2, 1.0).when(common > 0, 0.7).otherwise(0.3)

    wa, wb = a("word_counts"), b("word_counts")
    worded = F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.5).otherwise(let(_shared(wa, wb), word_score))
    same_doc = both_docs & (doc_a == doc_b)
    text_a, text_b = a("text_counts"), b("text_counts")
    text_hit = (F.size(text_a) > 0) & (F.size(text_b) > 0) & (_shared(text_a, text_b)["common"] >= 2)
    ocr_score = F.when(same_doc | F.col("_text_hit"), 1.0).otherwise(0.5)

    people_known = a("people_count").isNotNull() & b("people_count").isNotNull()
    people_close = F.coalesce(F.abs(a("people_count") - b("people_count")) <= 1, F.lit(False))
    people_score = F.when(~people_known, 0.5).when(people_close, 1.0).otherwise(0.2)

    same_event = F.coalesce((F.lower(a("event_type")) == F.lower(b("event_type"))) & (a("event_type") != ""), F.lit(False))
    event_score = F.when(same_event, 1.0).otherwise(0.5)
    seconds = F.abs(F.unix_micros(a("taken_at")) - F.unix_micros(b("taken_at"))) / 1_000_000

    consistency = F.floor(
        (obj_score * 0.35 + scene_score * 0.25 + F.col("_word_score") * 0.20 + ocr_score * 0.10
         + people_score * 0.05 + event_score * 0.05) * 100 + 0.5
    ).cast("int")
    reasons = F.array_compact(
        F.array(
            F.when(obj_known & obj_common.isNotNull(), F.concat(F.lit("Depict matching "), obj_common)),
            F.when(scenes & scene_ok, F.concat(_lowered(a("scene")), F.lit(" scene detected"))),
            F.when(F.col("_word_score") == 1.0, "Matching caption descriptions"),
            F.when(same_doc, F.concat(F.lit("Same document type ("), doc_a, F.lit(")"))),
            F.when(F.col("_text_hit"), "Matching OCR text"),
            F.when(people_known & people_close & (a("people_count") > 0), "Matching people count"),
            F.when(same_event, F.concat(F.lit("Matching "), F.lower(a("event_type")), F.lit(" event"))),
            F.when(seconds <= 30, F.concat(F.lit("Captured within "), F.floor(seconds + 0.5).cast("string"), F.lit(" seconds"))),
        )
    )
    explained = F.when(
        F.size("reasons") > 0, F.concat(F.lit("Grouped because: • "), F.array_join("reasons", " • "))
    ).otherwise("Grouped based on visual similarity and metadata consistency.")
    return (
        pairs.filter(~doc_clash & scene_ok)
        .withColumn("_word_score", worded)
        .withColumn("_text_hit", text_hit)
        .withColumn("consistency", consistency)
        .withColumn("reasons", reasons)
        .withColumn("confidence", F.floor(0.5 * visual + 0.5 * F.col("consistency") + 0.5).cast("int"))
        .withColumn("explanation", explained)
        .withColumn("is_similar", (F.col("consistency") >= 40) & (F.size("reasons") > 0))
        .drop("_word_score", "_text_hit")
    )
