"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

Each language gets a character 5-gram model with one discount per order. Grams of all languages lie in one array per
order, sorted by hash, with a first-level index over the upper bits; each gram points to the languages that have it and
their interpolated log-probabilities (contexts: their back-off weights), so a character of a text costs one look-up
for all languages together, and memory is linear in the languages. A text goes to the language with the lowest cross-entropy per character, and is
rejected if that value lies too far above what texts of the language and of that length showed on a calibration fold.

Models are fitted on a sample of at most about ``SAMPLE`` labelled texts per language (whole texts, chosen by hash), each
language in a task of its own and from all grams of its sample. Of the fitted model at most ``MODEL_GRAMS`` entries per
language and order are kept, and its back-off weights follow, so what is sent to the tasks has a bound that is linear in
the languages and no language depends on how many others there are. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.llm.shingles import chunks, mixed
from albumetry.llm.tables import kept_whole, text_batches

ORDER = 5
BITS = 12  # of a letter's number in a gram
BOUNDARY = 1
SAMPLE = 2_000  # labelled texts per language
MODEL_GRAMS = 1 << 18  # of a language and order
REJECTED = 0.001  # share of a language's own texts that lies beyond its limit
TAIL = 0.1  # share of the calibration texts that the limit is extrapolated from
UNKNOWN = "und"


def letter_numbers() -> np.ndarray:
    """Number of every code point: letters by their lower case, all else the boundary.

    Letters of alphabets keep their code point; those from U+0E00 share 512 numbers.
    """
    out = np.full(0x110000, BOUNDARY, dtype=np.uint16)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            p = ord(low) if len(low) == 1 else point
            out[point] = p if p < 0x0E00 else 0x0E00 + (p * 2654435761 >> 7) % 512
    return out


def sequences(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, owner, letters): the 5-gram ending at each character, its text, and letters per text.

    Runs of non-letters count as one boundary; every text begins after boundaries.
    """
    pad = ORDER - 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer(("\0" * pad + ("\0" * pad).join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = numbers[points]
    ends = np.cumsum(sizes + pad)
    begins = ends - sizes
    padding = np.zeros(len(ids), dtype=bool)
    for k in range(1, pad + 1):
        padding[begins - k] = True
    boundary = ids == BOUNDARY
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = ~(boundary[1:] & boundary[:-1])
    keep |= padding
    owner = np.repeat(np.arange(len(texts)), sizes + pad)[keep]
    x, real = ids[keep].astype(np.uint64), ~padding[keep]
    grams = x[pad:].copy()
    for k in range(1, ORDER):
        grams |= x[pad - k: len(x) - k] << np.uint64(BITS * k)
    real = real[pad:]
    letters = np.bincount(np.repeat(np.arange(len(texts)), sizes + pad)[~boundary & ~padding], minlength=len(texts))
    return grams[real], owner[pad:][real], letters


class HashArray:
    """Sorted hashes with an index over their upper bits."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, int(2 * len(hashes)).bit_length())
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.shift = np.uint64(64 - bits)
        buckets = (hashes >> self.shift).astype(np.int64)
        self.index = np.searchsorted(buckets, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's hash, -1 if it is not there."""
        h = mixed(keys)
        bucket = (h >> self.shift).astype(np.int64)
        at = self.index[bucket]
        out = np.where(self.hashes[at] == h, at, -1)
        todo = np.flatnonzero((out < 0) & (at + 1 < self.index[bucket + 1]))
        at, end, h = at[todo] + 1, self.index[bucket[todo] + 1], h[todo]
        while len(todo):
            hit = self.hashes[at] == h
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, h = todo[more], at[more] + 1, end[more], h[more]
        return out


class Sparse:
    """Values by key and language: a hash array of the keys, each with its run of (language, value)."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        h = mixed(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        own, begin = np.unique(h[order], return_index=True)
        self.places = HashArray(own)
        self.begin = np.append(begin, len(h)).astype(np.int64)
        self.language = np.repeat(np.arange(len(keys)), [len(k) for k in keys]).astype(np.int32)[order]
        self.value = np.concatenate(values).astype(np.float32)[order] if values else np.zeros(0, np.float32)

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``at``, language, value) of all values at the places ``at``."""
        n = self.begin[at + 1] - self.begin[at]
        rows = np.repeat(np.arange(len(at)), n)
        i = np.arange(len(rows)) + np.repeat(self.begin[at] - (np.cumsum(n) - n), n)
        return rows, self.language[i], self.value[i]


def far_quantile(z: np.ndarray, beyond: float = REJECTED) -> float:
    """Value that the share ``beyond`` passes: the quantile of ``z`` or, if higher, that of an exponential upper tail.

    The tail's mean is taken two standard errors high, as few values say little about where the rare ones lie.
    """
    start = float(np.quantile(z, 1 - TAIL))
    over = z[z > start] - start
    mean = float(over.mean()) * (1 + 2 / np.sqrt(len(over))) if len(over) else 0.0
    return max(float(np.quantile(z, 1 - beyond)), start + mean * float(np.log(TAIL / beyond)))


@dataclass
class Model:
    """``grams[n]``: log-probabilities at order n + 2; ``contexts[n]``: their back-off weights; ``first``: order 1."""

    languages: list[str]
    grams: list
    contexts: list
    first: np.ndarray
    numbers: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # variance = spread[:, 0] + spread[:, 1] / length
    farthest: np.ndarray | None = None  # deviations above the mean that lead to rejection
    sharpness: float = 1.0

    def _logs(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return self.first[keys.astype(np.int64)]
        grams, contexts = self.grams[order - 2], self.contexts[order - 2]
        at = grams.places.find(keys)
        found = np.flatnonzero(at >= 0)
        out = np.empty((len(keys), len(self.languages)), dtype=np.float32)
        partly = np.ones(len(keys), dtype=bool)  # not in all languages
        partly[found] = grams.begin[at[found] + 1] - grams.begin[at[found]] < len(self.languages)
        miss = np.flatnonzero(partly)
        if len(miss):
            rest = keys[miss]
            back = self._logs(rest & np.uint64((1 << BITS * (order - 1)) - 1), order - 1)
            context = contexts.places.find(rest >> np.uint64(BITS))
            known = np.flatnonzero(context >= 0)
            rows, language, weight = contexts.entries(context[known])
            back[known[rows], language] += weight
            out[miss] = back
        rows, language, value = grams.entries(at[found])
        out[found[rows], language] = value
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character under each language, characters, letters) of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        length, letters = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for first, part in chunks(texts, min(1 << 19, max(1 << 13, (1 << 21) // max(1, len(self.languages))))):
            grams, owner, found = sequences(part, self.numbers)
            letters[first: first + len(part)] = found
            if len(grams):
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                rows = first + owner[begin]
                total[rows] = np.add.reduceat(self._logs(grams, ORDER), begin, axis=0, dtype=np.float64)
                length[rows] = np.diff(np.append(begin, len(owner)))
        return -total / np.maximum(length, 1)[:, None], length, letters

    def identify(self, texts: list) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and accepted of each text."""
        entropy, length, letters = self.entropies([t if isinstance(t, str) else "" for t in texts])
        out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": np.nan, "accepted": False}, index=range(len(texts)))
        some = np.flatnonzero(letters > 0)
        if not len(some) or not self.languages:
            return out
        e = entropy[some]
        best = e.argmin(axis=1)
        lowest = e[np.arange(len(some)), best]
        p = np.exp(-self.sharpness * np.sqrt(length[some])[:, None] * (e - lowest[:, None]))
        limit = self.mean[best] + self.farthest[best] * np.sqrt(self.spread[best, 0] + self.spread[best, 1] / length[some])
        out.loc[some, "lang_pred"] = np.array(self.languages, dtype=object)[best]
        out.loc[some, "score"] = 1 / p.sum(axis=1)
        out.loc[some, "cross_entropy"] = lowest
        out.loc[some, "accepted"] = lowest <= limit
        return out

    def calibrate(self, texts: list[str], labels: list[str]) -> None:
        """Sets the rejection limits and the score's sharpness from labelled texts that were not learned from."""
        n = len(self.languages)
        self.mean, self.spread, self.farthest = np.full(n, np.inf), np.ones((n, 2)), np.ones(n)
        entropy, length, letters = self.entropies(texts)
        label = np.array([self.languages.index(x) if x in self.languages else -1 for x in labels])
        use = (label >= 0) & (letters > 0)
        entropy, length, label = entropy[use], length[use], label[use]
        for k in range(n):
            own, size = entropy[label == k, k], length[label == k]
            if len(own) < 5:
                continue  # too few to set a limit: nothing is rejected
            self.mean[k] = np.median(own)
            # the usual case sets the limits: residuals beyond 5 robust deviations are left out
            r = (own - self.mean[k]) * np.sqrt(size)
            r2 = r[np.abs(r) <= 5 * 1.4826 * np.median(np.abs(r)) + 1e-9] ** 2
            within = float(r2.mean())
            between = max(0.0, float(np.mean((own - self.mean[k]) ** 2 - within / size)))
            self.spread[k] = max(between, 1e-4), max(within, 1e-2)
            self.farthest[k] = far_quantile((own - self.mean[k]) / np.sqrt(self.spread[k, 0] + self.spread[k, 1] / size))
        lowest = entropy.min(axis=1, keepdims=True) if len(entropy) else entropy
        best = (-np.inf, 1.0)
        for sharpness in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            if len(entropy):
                z = -sharpness * np.sqrt(length)[:, None] * (entropy - lowest)
                fit = float((z[np.arange(len(label)), label] - np.log(np.exp(z).sum(axis=1))).mean())
                best = max(best, (fit, sharpness))
        self.sharpness = best[1]


Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # grams, log-probabilities, contexts, log back-off weights


def smoothed(grams: np.ndarray, counts: np.ndarray, most: int = MODEL_GRAMS) -> tuple[np.ndarray, list[Table]]:
    """(log-probabilities of order 1, tables of the orders from 2) of one language, from all its 5-grams.

    The highest order uses counts, lower orders the number of distinct letters before a gram; every order n has the
    discount D = n1 / (n1 + 2 n2) of its counts of one and two and is interpolated with the next lower order. Only then
    the ``most`` grams of an order with the highest counts are kept; what the others held goes to the back-off weights.
    """
    size = 1 << BITS
    g = np.asarray(grams, np.uint64)
    o = np.argsort(g)
    tables = [(g[o], np.asarray(counts, np.float64)[o])]
    for n in range(ORDER - 1, 0, -1):
        g, c = np.unique(tables[0][0] & np.uint64((1 << BITS * n) - 1), return_counts=True)
        tables.insert(0, (g, c.astype(np.float64)))
    below, union = np.full(size, 1.0 / size), np.arange(size, dtype=np.uint64)  # of the next lower order, all its grams
    first, kept = below, []
    whole = True

    def pruned(keys: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of grams of order n under what is kept."""
        if n == 1:
            return first[keys.astype(np.int64)]
        own, p, head, gamma = kept[n - 2]
        out = pruned(keys & np.uint64((1 << BITS * (n - 1)) - 1), n - 1)
        for there, values, seek, times in ((head, gamma, keys >> np.uint64(BITS), True), (own, p, keys, False)):
            if len(there):
                at = np.minimum(np.searchsorted(there, seek), len(there) - 1)
                hit = there[at] == seek
                out[hit] = out[hit] * values[at[hit]] if times else values[at[hit]]
        return out

    for n, (g, c) in enumerate(tables, 1):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5
        head, at, kinds = np.unique(g >> np.uint64(BITS), return_inverse=True, return_counts=True)
        sums = np.bincount(at, weights=c, minlength=len(head))
        gamma = d * kinds / sums
        if n == 1:
            first = (gamma[0] if len(gamma) else 1.0) * below
            first[g.astype(np.int64)] += (c - d) / sums[at]
            below = first
            continue
        suffix = g & np.uint64((1 << BITS * (n - 1)) - 1)
        p = (c - d) / sums[at] + gamma[at] * below[np.searchsorted(union, suffix)]
        below, union = p, g
        if len(g) > most:
            whole = False
            stay = np.sort(np.lexsort((g, -c))[:most])
            g, p, suffix = g[stay], p[stay], suffix[stay]
        if not whole:
            head, at = np.unique(g >> np.uint64(BITS), return_inverse=True)
            left, lower = (np.maximum(1 - np.bincount(at, weights=x, minlength=len(head)), 1e-12) for x in (p, pruned(suffix, n - 1)))
            gamma = left / lower
        kept.append((g, p, head, gamma))
    return np.log(first), [(g, np.log(p), head, np.log(gamma)) for g, p, head, gamma in kept]


def assembled(parts: dict[str, tuple[np.ndarray, list[Table]]], numbers: np.ndarray) -> Model:
    """Model of all languages from the tables of each."""
    languages = sorted(parts)

    def joined(n: int, keys: int) -> Sparse:
        return Sparse([parts[x][1][n][keys] for x in languages], [parts[x][1][n][keys + 1] for x in languages])

    first = np.stack([parts[x][0] for x in languages], axis=1).astype(np.float32) if languages else np.zeros((1 << BITS, 0), np.float32)
    orders = range(ORDER - 1)
    return Model(languages, [joined(n, 0) for n in orders], [joined(n, 2) for n in orders], first, numbers)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], numbers: np.ndarray, most: int = MODEL_GRAMS) -> Model:
    """Model from (5-grams, counts) of each language."""
    return assembled({lang: smoothed(g, c, most) for lang, (g, c) in counts.items()}, numbers)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def fit(docs: DataFrame, held_out: int = 2, calibration: int = 1, sample: int = SAMPLE) -> Model:
    """Model from labelled texts outside the fold ``held_out``; the fold ``calibration`` sets limits only."""
    spark = docs.sparkSession
    learn = text_batches(docs).select("doc_id", "lang", "text").withColumn("_fold", fold_of(F.col("doc_id"))).filter(
        (F.col("_fold") != held_out) & F.col("lang").isNotNull())
    sizes = learn.groupBy("lang").agg(F.count("*").alias("_n"))
    chance = (F.lit(float(sample)) / F.col("_n") * (1 << 30)).cast("long")
    chosen = learn.join(F.broadcast(sizes), "lang").filter(  # one row per language
        (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < chance) & F.col("text").isNotNull())
    numbers = letter_numbers()
    shared = spark.sparkContext.broadcast(numbers)  # 2 MB

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for _, texts in chunks(part["text"].tolist(), 1 << 20):
                    grams, n = np.unique(sequences(texts, shared.value)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    counted = chosen.filter(F.col("_fold") != calibration).select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = MODEL_GRAMS

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        first, tables = smoothed(part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(), most)
        raw = [[x.tobytes() for x in (g, p.astype(np.float32), head, gamma.astype(np.float32))] for g, p, head, gamma in tables]
        rows = [[part["lang"].iloc[0], n, *r] for n, r in enumerate([[b"", first.tobytes(), b"", b""], *raw])]
        return pd.DataFrame(rows, columns=["lang", "n", "grams", "p", "contexts", "gamma"])

    # at most ``MODEL_GRAMS`` entries per language and order
    fit_rows = counted.groupBy("lang").applyInPandas(fitted, "lang string, n int, grams binary, p binary, contexts binary, gamma binary")
    parts: dict = {}
    for r in sorted(fit_rows.toArrow().to_pylist(), key=lambda r: (r["lang"], r["n"])):
        if r["n"] == 0:
            parts[r["lang"]] = (np.frombuffer(r["p"], np.float64), [])
        else:
            kinds = (("grams", np.uint64), ("p", np.float32), ("contexts", np.uint64), ("gamma", np.float32))
            parts[r["lang"]][1].append(tuple(np.frombuffer(r[k], t) for k, t in kinds))
    model = assembled(parts, numbers)
    tested = chosen.filter(F.col("_fold") == calibration)
    # as many texts again at most: one in four of the sample
    rows = tested.select("lang", "text").toArrow().to_pandas() if model.languages else pd.DataFrame({"lang": [], "text": []})
    model.calibrate(rows["text"].tolist(), rows["lang"].tolist())
    return model


FOUND = "lang_pred string, score double, cross_entropy double, accepted boolean"


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column ``_found`` (lang_pred, score, cross_entropy, accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        return shared.value.identify(texts.tolist())

    return docs.withColumn("_found", find("text"))


def predict(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, cross_entropy, accepted.

    Learns from labelled rows outside the fold ``held_out`` only; a prediction sees the text alone. ``score`` is the
    calibrated share of the chosen language among all; ``accepted`` is false for texts whose cross-entropy lies beyond
    the calibrated limit. Null texts and texts without a letter are ``und`` with score 0, not accepted; so is all if
    nothing is labelled. Ties go to the first language by name; repeated rows get equal rows; an empty table gives
    none; other columns are ignored. Texts of any length are read whole.
    """
    found = identified(docs.select("doc_id", "text"), fit(docs, held_out))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == held_out).alias("held_out"), "_found.*")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified without rejection; columns of ``docs``. Cases as in ``predict``."""
    return identified(kept_whole(docs, "text"), fit(docs)).filter("_found.accepted").select("row.*")
