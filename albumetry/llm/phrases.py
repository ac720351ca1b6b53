"""Phrase collocations by Toivonen's mining: a sample proposes, one full pass counts, failures of the border expand.

A phrase can be frequent only if the phrases without its last and without its first word are. Let S be a set of phrases held
to be frequent. What must be counted is S and its negative border: all phrases whose two parts of one word less lie in
S (every single word, to begin with). A pass over the texts counts exactly these, so the border is never listed.

1. A sample of the documents, a fixed share drawn by hash, is mined with a lowered limit; its frequent phrases are S.
2. A full pass counts S and its border exactly.
3. Where a phrase of the border turns out frequent, S lacked it and what it leads to was not counted: it joins S, and
   another full pass counts what is newly let in, and only that. No failure is left after at most one pass per length.

S goes to the tasks as a bitmap of fixed size. A bit that two phrases share lets in more to be counted, never less, and the
same bits decide in each pass what has been counted before, so counts stay exact. Words are found and hashed in whole
batches; each batch sends one row per distinct phrase, and all counts are summed by (lang, phrase) text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetry.llm.pretokens import gathered
from albumetry.llm.shingles import mixed, powers, word_hashes
from albumetry.llm.tables import text_batches, written
from albumetry.operators.scale import lookup_join

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2000  # phrases reported of a language
SAMPLE = 8  # one document in so many is in the sample
SAMPLE_LEAST = 2  # lowered limit there: below LEAST / SAMPLE, so that few frequent phrases are missed
BITS = 26  # 8 MB bitmap of S
PART = 1 << 20  # bytes of text counted at a time
PER_TASK = 50_000  # rows of one phrase looked up in one task
FALLBACK = "und"

# Classes of bytes: 0 in a word, 1 between words, 2 between pieces. Letters outside ASCII have bytes of class 0 alone.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]")

COUNTED = "lang string, phrase string, n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def parts_of(texts: list[bytes], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (row, bytes) of about ``limit`` bytes; longer texts are cut where a piece ends."""
    held, size = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > limit and (cut := _CUT.search(text, at + limit)):
                end = cut.end()
            if held and size + end - at > limit:
                yield held
                held, size = [], 0
            held.append((row, text[at:end]))
            size += end - at
            at = end
    if held:
        yield held


class Words:
    """All words of some texts: hashes, pieces, languages, and their bytes joined by single spaces."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        kind = _CLASS[data]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, end = (np.append(0, edge) if word[0] else edge).reshape(-1, 2).T  # the last byte is in no word
        self.hashes = word_hashes(data, start, end)
        self.piece = np.cumsum(kind == 2)[start]
        sizes = np.array([len(t) + 1 for t in texts])
        self.lang = langs[np.searchsorted(np.cumsum(sizes), start, side="right")]
        data[end] = 32
        word[end] = True
        self.flat = data[word]
        self.size = end - start
        self.begin = np.cumsum(self.size + 1) - self.size - 1


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    at = keys >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def let_in(words: Words, lang_seeds: np.ndarray, before: np.ndarray | None, bits: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """(first word, length, key) of every occurrence of a phrase that ``bits`` let in and ``before`` did not."""
    n = len(words.hashes)
    up, _ = powers(longest + 1)
    seeds = lang_seeds[words.lang]
    found = []
    at = np.arange(n)
    rolled = np.zeros(n, dtype=np.uint64)
    inside = was = None
    for k in range(1, longest + 1):
        if k > 1:
            # both parts of one word less in S, within one piece
            more = np.flatnonzero(inside[:-1] & inside[1:] & (words.piece[: n - 1] == words.piece[1:])) if k == 2 else \
                np.flatnonzero(inside[:-1] & inside[1:])
            at = more[more + k <= n]
            new = ~(was[at] & was[at + 1]) if was is not None else None
        else:
            new = None
        rolled[at] += mixed(words.hashes[at + k - 1] + np.uint64(k)) * up[k]
        key = mixed(rolled[at] ^ seeds[at] ^ np.uint64(k))
        if before is None:
            found.append((at, key, k))
        elif k > 1:
            found.append((at[new], key[new], k))
        if k < longest:
            now = np.zeros(n, dtype=bool)
            now[at] = has(bits, key)
            if before is not None:
                old = np.zeros(n, dtype=bool)
                old[at] = has(before, key) if new is None else has(before, key) & ~new  # a shared bit counted nothing
                was = old
            inside = now
    return tuple(np.concatenate(x) for x in zip(*[(a, np.full(len(a), k), key) for a, key, k in found]))


def _seeds(langs: pa.Array) -> np.ndarray:
    """A number of each language."""
    names = (x.encode("utf-8", "surrogatepass") for x in langs.to_pylist())
    return np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in names], dtype=np.uint64)


def counted(docs: DataFrame, before: np.ndarray | None, bits: np.ndarray, longest: int) -> DataFrame:
    """(lang, phrase, n) of all phrases that ``bits`` let in and ``before`` did not; in a first pass also the number of all
    words of a language, as that of the empty phrase."""
    shared = docs.sparkSession.sparkContext.broadcast((before, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bits = shared.value
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            codes, names = lang.indices.to_numpy(), lang.dictionary
            seeds = _seeds(names)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            for part in parts_of(texts, PART):
                words = Words([t for _, t in part], codes[[r for r, _ in part]])
                if not len(words.hashes):
                    continue
                first, k, key = let_in(words, seeds, before, bits, longest)
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool))
                n = np.diff(np.append(new, len(key)))
                first, k = first[order[new]], k[order[new]]
                for a in range(0, len(n), 1 << 15):
                    b = a + (1 << 15)
                    yield _rows(words, names, first[a:b], k[a:b], n[a:b])
                if before is None:
                    of = np.bincount(words.lang, minlength=len(names))
                    here = np.flatnonzero(of)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(here)), pa.array([""] * len(here)), pa.array(of[here])], schema=_SCHEMA)

    rows = docs.mapInArrow(count, COUNTED)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _rows(words: Words, names: pa.Array, first: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    last = first + k - 1
    begin, end = words.begin[first], words.begin[last] + words.size[last]
    bounds = np.stack((begin, end), axis=1).ravel()  # every second stretch is a phrase
    flat = gathered(words.flat, bounds, np.arange(0, len(bounds), 2))
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(flat))
    return pa.RecordBatch.from_arrays([names.take(pa.array(words.lang[first])), text, pa.array(n)], schema=_SCHEMA)


def keyed(rows: DataFrame, longest: int) -> DataFrame:
    """(lang, k, key, phrase, n): the rows with their number of words and the key that ``let_in`` gives them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, _ = powers(longest + 1)
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("phrase").to_pylist()]
            words = Words(texts, np.arange(len(texts)))  # in place of languages, the row of each word
            k = np.bincount(words.lang, minlength=len(texts))
            at = np.arange(len(words.lang)) - np.repeat(np.cumsum(k) - k, k) + 1
            rolled = np.zeros(len(texts), dtype=np.uint64)
            np.add.at(rolled, words.lang, mixed(words.hashes + at.astype(np.uint64)) * up[at])
            key = mixed(rolled ^ _seeds(lang.dictionary)[lang.indices.to_numpy()] ^ k.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(k.astype(np.int32)), pa.array(key.view(np.int64)),
                                              batch.column("phrase"), batch.column("n")], names=["lang", "k", "key", "phrase", "n"])

    return rows.mapInArrow(find, "lang string, k int, key long, phrase string, n long")


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bits of the rows' keys, 2^bits of them whatever the number of rows; set by Spark, collected in 4 kB rows."""
    at = rows.select((F.shiftrightunsigned("key", 64 - bits) + 1).alias("p"))  # the functions count from 1
    found = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in found.collect():  # at most 2^bits / 32768 rows
        out[(r["n"] - 1) * 4096: r["n"] * 4096] = np.frombuffer(r["b"], dtype=np.uint8)
    return out


def closed(docs: DataFrame, proposed: np.ndarray, least: int, longest: int, bits: int = BITS) -> tuple[DataFrame, np.ndarray, int]:
    """(phrases with at least ``least`` occurrences and their numbers, bitmap of S, passes): passes until the border holds."""
    found, before, now, passes = None, None, proposed, 0
    while True:
        rows = written(keyed(counted(docs, before, now, longest).filter(f"phrase = '' or n >= {least}"), longest))
        passes += 1
        found = rows if found is None else found.unionByName(rows)
        more = now | bitmap(rows.filter(f"k between 1 and {longest - 1}"), bits)
        if np.array_equal(more, now):
            return found, now, passes
        before, now = now, more


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE,
             sample_least: int = SAMPLE_LEAST, bits: int = BITS) -> tuple[DataFrame, int]:
    """((lang, k, phrase, n), full passes): all phrases of 1 to ``longest`` words that occur at least ``least`` times in
    a language, and (k = 0) its number of words. The sample decides how much is counted, never what is found."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(FALLBACK)).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_draw"))
    docs = text_batches(docs)
    drawn = docs.filter(F.pmod("_draw", F.lit(sample)) == 0).select("lang", "text")
    _, proposed, _ = closed(drawn, np.zeros(1 << (bits - 3), dtype=np.uint8), sample_least, longest, bits)
    found, _, passes = closed(docs.select("lang", "text"), proposed, least, longest, bits)
    return found.drop("key"), passes


def _part(words, first, size):
    """Name of a phrase's part within its language; no phrase holds a line end."""
    return F.concat_ws("\n", "lang", F.array_join(F.slice(words, first, size), " "))


def _looked_up(rows: DataFrame, table: DataFrame, part: str, value: str, per_task: int) -> DataFrame:
    """``rows`` with the count ``value`` of their part; parts that very many rows ask for are spread over tasks."""
    asked = rows.groupBy(part).agg(F.count("*").alias("_asked"))
    found = table.select(F.concat_ws("\n", "lang", "phrase").alias(part), F.col("n").alias(value)).join(asked, part)
    return lookup_join(rows, found, part, "_row", count="_asked", rows_per_task=per_task, how="inner").drop("_asked")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = 80,
                 sample: int = SAMPLE, per_task: int = PER_TASK) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?]`` and line ends into pieces, these at spaces and tabs into words. a is the
    phrase's number of occurrences (at least ``least``), n the language's number of words. A cut after k words gives l and r,
    the numbers of both parts, and floor(2000000 * a / (l + r)); the lowest is the score, the smallest k among equal ones.
    A phrase goes if a longer candidate holds its words in a row and has ``covered`` % of its number. The first ``top`` by
    score, a and phrase (byte order) stay. Null languages are ``und``; null and empty texts have no words; rows
    that repeat count each; texts of any length count whole; an empty table gives no rows; other columns are ignored.
    """
    found, _ = frequent(docs, least, longest, sample)
    found = written(found)
    words = F.split("phrase", " ")
    candidates = found.filter("k >= 2")
    named = candidates.select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"), F.xxhash64("lang", "phrase").alias("_row"))
    cuts = named.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumns({"_l": _part("w", F.lit(1), F.col("cut")), "_r": _part("w", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.select("lang", "phrase", "a", "cut", "_l", "_r", "_row")
    cuts = _looked_up(_looked_up(cuts, found, "_l", "l", per_task), found, "_r", "r", per_task)
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div cast(l + r as decimal(19,0))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))

    # candidates within longer candidates, by the largest number of these
    longer = named.filter("k > 2").withColumn("_size", F.explode(F.expr("sequence(2, k - 1)")))
    longer = longer.withColumn("_at", F.explode(F.expr("sequence(1, k - _size + 1)")))
    inner = longer.groupBy("lang", F.array_join(F.slice("w", F.col("_at"), F.col("_size")), " ").alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (F.col("_longer").cast("decimal(22,0)") * 100 < F.col("a").cast("decimal(22,0)") * covered))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    # first within shares of a language, so that no task ranks all of its phrases
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = Window.partitionBy("lang", "_share").orderBy(*order)
    kept = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("_n", F.row_number().over(share))
    kept = kept.filter(F.col("_n") <= top).drop("_n", "_share")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("k = 0").select("lang", "n")
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
