"""Alignment of two tokenizers over the same texts.

Tokenizer A is a byte-level one that gets a space and the text; B is a sentencepiece model that adds the space itself. Both
cut the same bytes, so each is a list of growing byte offsets where its tokens end.

1. Per document, the shorter list of ends drives a galloping search into the longer: from the place where an end would
   lie if tokens were evenly long, steps double until the end is bracketed, then a binary search closes in. All ends
   of many documents take the same step at once. This gives each end's rank in the other list and whether it is there.
2. Ends in both lists cut the tokens into groups. The ranks of two neighbouring ends differ by the number of ends between
   them, so they are the range of tokens that a token overlaps. An overlapping pair is one stretch between neighbouring ends
   of either list; there are as many pairs as ends.
3. Pairs of ids are counted over the whole table: each task counts a bounded number of documents before anything is sent.
4. Documents get the counts of their pairs. The ``HOT`` most frequent pairs go to all tasks (a fixed number of rows); all
   others are joined by shuffle. What is frequent is thus never shuffled, and what is shuffled has no frequent key.

Texts are never shuffled; the links of a document are written as distinct pairs with their numbers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumetry.llm.pretokens import PieceIds, Ranges, Splitter, byte_letters, gathered, tokenizers_classes
from albumetry.llm.tables import kept_whole, text_batches, written

HOT = 1 << 18  # most frequent id pairs that every task gets
PART = 1 << 20  # bytes of text aligned at a time, or one longer text
BLOCK_PAIRS = 1 << 19  # distinct pairs that a task counts before it sends them on
SHIFT = 32  # a pair of ids is a * 2^32 + b
MARK = "▁"
SEGMENT = re.compile(" +[^ ]*")
BYTE = re.compile("<0x([0-9A-F]{2})>")


class ByteLevel:
    """Ids and byte lengths by a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str, pattern: str, classes: dict[str, Ranges]):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model  # without the special tokens
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.split = Splitter(pattern, classes)
        self.known = PieceIds(self._encode)
        self.sizes = _sizes(Tokenizer.from_file(path).get_vocab(with_added_tokens=False), len)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokenize(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for p in pieces]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a space and the text."""
        return self.known.ids(self.split(" " + text))

    def whole(self, text: str, ids: np.ndarray) -> bool:
        """The tokens' bytes are those of the text; a byte-level vocabulary with all bytes loses none."""
        return int(self.sizes[ids].sum()) == len(text.encode("utf-8", "surrogatepass")) + 1


class Pieces:
    """The same by a sentencepiece model whose pieces hold no space but in front; segments of a text are then independent."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [self._bytes(k, p) for k, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.space = [self.model.piece_to_id(MARK)]
        self.known = PieceIds(self._encode)
        self.changed: dict[str, bool] = {}

    def _bytes(self, number: int, piece: str) -> bytes:
        if self.model.is_byte(number):
            return bytes([int(BYTE.fullmatch(piece)[1], 16)])
        return piece.replace(MARK, " ").encode()

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        encode, own = self.model.encode, self.bytes
        found = [encode(p[1:]) if len(p) > 1 else self.space for p in pieces]  # the model adds the first space
        # segments whose bytes are not the pieces' are remembered; few, as are the letters that do it
        self.changed |= {p: True for p, ids in zip(pieces, found) if b"".join([own[k] for k in ids]) != p.encode("utf-8", "surrogatepass")}
        return found

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of the text, or None if their bytes are not those of a space and the text."""
        text = " " + text
        segments = SEGMENT.findall(text) if self.apart else [text]
        if len(self.changed) > 100_000:
            self.changed.clear()
            self.known._empty()
        found = self.known.ids(segments)
        return None if self.changed and any(map(self.changed.__contains__, segments)) else found


def _sizes(vocabulary: dict[str, int], size) -> np.ndarray:
    out = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, number in vocabulary.items():
        out[number] = size(token)
    return out


def galloped(ends: np.ndarray, longer: np.ndarray, first: np.ndarray, last: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each of ``ends``, the first place in ``longer[first:last]`` (sorted) whose value is no smaller; ``last`` if none.

    Exponential search to either side of ``guess``, then binary search, in lock step over all ends.
    """
    at = np.clip(guess, first, np.maximum(last - 1, first))
    value = longer[np.minimum(at, len(longer) - 1)]
    up = (value < ends) & (at < last)  # look to the right
    low, high = np.where(up, at + 1, first), np.where(up, last, at)  # the answer lies in low .. high
    low, high, step = low.copy(), high.copy(), 1
    open_ = np.flatnonzero(low < high)
    while len(open_):
        right, e = up[open_], ends[open_]
        probe = np.where(right, np.minimum(low[open_] + step - 1, high[open_] - 1), np.maximum(high[open_] - step, low[open_]))
        less = longer[probe] < e
        low[open_] = np.where(less, probe + 1, low[open_])
        high[open_] = np.where(less, high[open_], probe)
        # bracketed on the far side, or on the way there
        done = np.where(right, ~less, less) | (low[open_] >= high[open_])
        open_ = open_[~done]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = longer[middle] < ends[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def _counted(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, joined."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> dict[str, np.ndarray]:
    """Alignment of documents that hold ``n_a`` and ``n_b`` tokens of the given byte lengths, one after the other.

    ``a_rank``: of each A end, the number of B ends before it (over all documents); ``a_common``, ``b_common``: the
    end is in both lists; ``link_a``, ``link_b``: tokens of each overlapping pair, in order of the bytes.
    """
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)  # equal totals per document, so offsets go on over documents
    a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
    a_from, b_from = a_to - n_a, b_to - n_b
    a_rank = np.zeros(len(a_end), dtype=np.int64)
    a_common, b_common = np.zeros(len(a_end), dtype=bool), np.zeros(len(b_end), dtype=bool)

    def search(docs, ends, other, own_from, own_n, other_from, other_n):
        own = _counted(own_from[docs], own_n[docs])
        doc = np.repeat(docs, own_n[docs])
        place = own - own_from[doc]
        guess = other_from[doc] + place * other_n[doc] // np.maximum(own_n[doc], 1)
        rank = galloped(ends[own], other, other_from[doc], other_from[doc] + other_n[doc], guess)
        return own, rank, other[rank] == ends[own]  # the last ends are equal, so no rank lies beyond

    by_a, by_b = np.flatnonzero(n_a <= n_b), np.flatnonzero(n_a > n_b)
    own, rank, both = search(by_a, a_end, b_end, a_from, n_a, b_from, n_b)
    a_rank[own], a_common[own] = rank, both
    b_common[rank[both]] = True
    own, rank, both = search(by_b, b_end, a_end, b_from, n_b, a_from, n_a)
    b_common[own] = both
    a_common[rank[both]] = True
    # number of B ends before an A end, from the ranks of B ends: those whose rank is at most the A end's place, less the equal one
    upto = np.cumsum(np.bincount(rank, minlength=len(a_end))[: len(a_end)]) if len(rank) else np.zeros(len(a_end), dtype=np.int64)
    for_b = np.repeat(n_a > n_b, n_a)
    before = np.repeat(b_from - np.append(0, upto)[np.minimum(a_from, len(upto))], n_a)
    a_rank[for_b] = (upto + before - a_common)[for_b]
    # a token of A overlaps the tokens of B from its start's to its end's rank
    start = np.empty_like(a_rank)
    start[1:] = a_rank[:-1] + a_common[:-1]
    if len(start):
        start[0] = 0
    overlap = a_rank - start + 1
    return {"a_rank": a_rank, "a_common": a_common, "b_common": b_common,
            "link_a": np.repeat(np.arange(len(a_end)), overlap), "link_b": _counted(start, overlap)}


class Names:
    """Decimal names of ids with the sign that follows, as bytes."""

    SIGNS = b",|;"

    def __init__(self, n: int):
        names = [str(k).encode() + self.SIGNS[s: s + 1] for k in range(n) for s in range(3)]
        self.flat = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.starts = np.append(0, np.cumsum([len(x) for x in names]))


def group_text(names: Names, a: np.ndarray, b: np.ndarray, a_common: np.ndarray, b_common: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one document."""
    # token k of A in group g stands behind the B tokens of the groups before g
    a_group, b_group = np.cumsum(a_common) - a_common, np.cumsum(b_common) - b_common
    b_ends, a_ends = np.flatnonzero(b_common) + 1, np.flatnonzero(a_common) + 1
    out = np.empty(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + np.append(0, b_ends)[a_group]] = a.astype(np.int64) * 3 + a_common
    out[np.arange(len(b)) + a_ends[b_group]] = b.astype(np.int64) * 3 + 2 * b_common
    return gathered(names.flat, names.starts, out)[:-1].tobytes()


class Aligner:
    """Both tokenizers, one pair per worker process."""

    def __init__(self, a_path: str, b_path: str, pattern: str, classes: dict[str, Ranges]):
        self.a, self.b = ByteLevel(a_path, pattern, classes), Pieces(b_path)
        self.names = Names(max(len(self.a.sizes), len(self.b.sizes)))

    def parts(self, texts: list) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
        """(rows, A ids, B ids) of the texts that both tokenizers keep whole, about ``PART`` bytes at a time."""
        rows, a, b, size = [], [], [], 0
        for row, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            ids_b = self.b.ids(text)
            ids_a = self.a.ids(text) if ids_b is not None else None
            if ids_a is None or not self.a.whole(text, ids_a):
                continue
            if rows and size + len(text) > PART:
                yield rows, a, b
                rows, a, b, size = [], [], [], 0
            rows.append(row)
            a.append(ids_a)
            b.append(ids_b)
            size += len(text)
        if rows:
            yield rows, a, b

    def align(self, texts: list) -> Iterator[tuple[int, int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(row, n_a, n_b, n_groups, n_links, groups, distinct pairs, their numbers) of every text with tokens."""
        for rows, a, b in self.parts(texts):
            ids_a, ids_b = np.concatenate(a), np.concatenate(b)
            n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            found = aligned(self.a.sizes[ids_a], self.b.sizes[ids_b], n_a, n_b)
            links = ids_a[found["link_a"]].astype(np.int64) << SHIFT | ids_b[found["link_b"]].astype(np.int64)
            a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
            link_to = np.searchsorted(found["link_a"], a_to)
            link_from = np.append(0, link_to[:-1])
            for k, row in enumerate(rows):
                own_a, own_b = slice(a_to[k] - n_a[k], a_to[k]), slice(b_to[k] - n_b[k], b_to[k])
                common = found["a_common"][own_a]
                text = group_text(self.names, a[k], b[k], common, found["b_common"][own_b])
                pairs, times = np.unique(links[link_from[k]: link_to[k]], return_counts=True)
                yield (row, int(n_a[k]), int(n_b[k]), int(common.sum()), int(link_to[k] - link_from[k]),
                       hashlib.sha256(text).hexdigest(), pairs, times)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str, pattern: str, classes: dict[str, Ranges]) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path, pattern, classes)
    return _aligners[a_path, b_path]


LINKS = ("kind int, line long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs array<long>, times array<long>")


def links(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Written rows of every document (kind 0: line, doc_id, numbers, digest of the groups, distinct pairs of ids and how
    often they are linked) and of every counted block (kind 1: pairs and times alone).
    """
    classes = tokenizers_classes()
    kind = LINKS.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in kind.split(", ")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(a_path, b_path, pattern, classes)
        line = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, weights=np.concatenate([t for _, t in held])).astype(np.int64)

        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"]
            rest = np.ones(len(texts), dtype=bool)
            out, letters = [], 0
            for row, *numbers in own.align(texts):
                rest[row] = False
                out.append((0, line + row, ids.iloc[row], *numbers))
                held.append(tuple(numbers[-2:]))
                size += len(numbers[-1])
                letters += len(numbers[-1])
                if size > 4 * BLOCK_PAIRS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > BLOCK_PAIRS:
                        out.append((1, None, None, None, None, None, None, None, *held[0]))
                        held, size = [], 0
                if letters > PART:  # rows may be long
                    yield pd.DataFrame(out, columns=names)
                    out, letters = [], 0
            none = np.zeros(0, dtype=np.int64)
            out += [(0, line + int(row), ids.iloc[row], 0, 0, 0, 0, "", none, none) for row in np.flatnonzero(rest)]
            line += len(texts)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([(1, None, None, None, None, None, None, None, *merged())], columns=names)

    return written(text_batches(docs).select("doc_id", "text").mapInPandas(find, kind))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): links of every pair of ids over the whole table; best if no pair of its B id has more."""
    blocks = found.filter("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = written(blocks.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most one row per id of B
    return written(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): how two tokenizers cut every text, and how often each pair of their ids overlaps.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: pair (a * 2^32 + b), count,
    best. Null and empty texts, and texts whose bytes a tokenizer does not give back (such as one with the letter that stands for
    a space), have no tokens: zeros and an empty digest. Rows that repeat, or share an id or a null one, stand for
    themselves and count each. Ties for the best count all. Texts of any length are aligned whole, so a text must
    fit in a task. An empty table gives no rows; other columns are ignored.
    """
    found = links(docs, a_path, b_path, pattern)
    counts = pair_counts(found)
    # the most frequent pairs, a fixed number; ties cut by the pair
    frequent = counts.orderBy(F.col("count").desc(), "pair").limit(hot)
    hot_pairs = written(frequent.withColumn("hot", F.lit(True)))
    own = found.filter("kind = 0").select("line", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    own = own.select("line", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = own.join(F.broadcast(hot_pairs), "pair", "left")

    def sums(rows: DataFrame) -> DataFrame:
        return rows.select("line", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                           (F.col("times") * F.col("count")).alias("count_sum"))

    cold = counts.join(hot_pairs.select("pair"), "pair", "left_anti")
    rare = met.filter("hot is null").select("line", "pair", "times").join(cold, "pair")
    per = sums(met.filter("hot")).unionByName(sums(rare)).groupBy("line").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = found.filter("kind = 0").drop("kind", "pairs", "times").join(per, "line", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                       F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"), counts
