"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Texts are tokenized once, where they lie. A document is cut at every multiple of the sequence length; full pieces
fill a sequence alone, and the tails are packed. Groups of about ``GROUP`` documents are drawn by hash, so each is a
random sample of all lengths, and a task packs one group at a time: pieces, longest first, go to the first open
sequence with room, found in a tournament tree whose inner nodes hold the largest free room below them. Only
(id, start, length, checksum) rows are shuffled, never texts or token ids.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetry.llm.pretokens import Ranges, Splitter, byte_letters, composed_otherwise, tokenizers_classes
from albumetry.llm.tables import text_batches

LENGTH = 2048
GROUP = 8192  # documents packed together; bounds a task's rows
END = 1  # id that closes a document
WORDS_KEPT = 500_000  # tokenized words a worker remembers before it starts anew

# The tokenizer's own splitting rule (fixed values of the vocabulary file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words for which the whole tokenizer is asked: its special tokens, letters whose lower case hangs on context,
# and separators that Python takes for white space but the tokenizer does not.
WHOLE = re.compile("<\\||[Σİ]|[\U00010000-\U0010ffff]")
# White space to Python but not to the tokenizer; texts with it go to the tokenizer whole.
SEPARATORS = r"\x1c-\x1f"
BEYOND = re.compile("[\U00010000-\U0010ffff]")


class WordIds(dict):
    """Number of a word; its ids lie in ``flat[starts[number]:starts[number + 1]]``. Words are tokenized when first met."""

    def __init__(self, path: str, classes: dict[str, Ranges], composed: Ranges):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.split = Splitter(PIECES, classes)
        # texts for which the whole tokenizer is asked: letters younger than Python's tables or the tokenizer's go there too
        named = [(a, b, f"\\U{a:08x}-\\U{b:08x}") for a, b in composed]
        self.apart_low = re.compile(f"[{SEPARATORS}{''.join(n for _, b, n in named if b < 1 << 16)}]").search
        self.apart_high = re.compile(f"[{''.join(n for a, _, n in named if a >= 1 << 16) or SEPARATORS}]").search
        self.flat, self.starts = array("I"), array("q", [0])

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts = array("I"), array("q", [0])

    def _ids(self, word: str) -> list[int]:
        if WHOLE.search(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out = []
        for piece in self.split(word.lower()):
            if not piece.isascii():
                piece = piece.encode().decode("latin-1")
            out += [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        return out

    def __missing__(self, word: str) -> int:
        number = len(self.starts) - 1
        self.flat.extend(self._ids(word))
        self.starts.append(len(self.flat))
        self[word] = number
        return number

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, equal to the tokenizer's, as unsigned 32-bit."""
        if self.apart_low(text) or (BEYOND.search(text) and self.apart_high(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if len(self) > WORDS_KEPT:
            self.reset()
        words = np.fromiter(map(self.__getitem__, text.split()), dtype=np.int64)
        if not len(words):
            return np.zeros(0, dtype="<u4")
        view = np.frombuffer(self.starts, dtype=np.int64)
        first, last = view[words], view[words + 1]
        del view  # an array under a view cannot grow
        sizes = last - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        view = np.frombuffer(self.flat, dtype=np.uint32)
        out = view[at]
        del view
        return out.astype("<u4", copy=False)


_known: dict[str, WordIds] = {}


def word_ids(path: str, classes: dict[str, Ranges], composed: Ranges) -> WordIds:
    """One table per worker process, kept between tasks."""
    if path not in _known:
        _known[path] = WordIds(path, classes, composed)
    return _known[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, line): every document cut at multiples of ``length``.

    Each row has a line of its own, by its task and place there.
    """
    classes, composed = tokenizers_classes(), composed_otherwise()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(tokenizer, classes, composed)
        line = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, start, size, crc, total = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                ids = known.encode(text) if isinstance(text, str) else np.zeros(0, dtype="<u4")
                n = len(ids) + 1
                raw = ids.tobytes() + END.to_bytes(4, "little")
                for at in range(0, n, length):
                    owner.append(k)
                    start.append(at)
                    size.append(min(length, n - at))
                    crc.append(zlib.crc32(raw[4 * at: 4 * (at + length)]))
                    total.append(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[owner], "start": start, "length": size,
                                "ids_crc32": crc, "doc_tokens": total, "line": np.arange(len(start)) + line})
            line += len(start)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, line long")


class Tournament:
    """Free room of bins 0, 1, 2, ...; finds the first bin with at least the room asked for."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first bin with room: (bin, room it had)."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        had = tree[node]
        tree[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each of the sizes, which come in descending order."""
    tree = Tournament(len(sizes), length)
    placed = []
    for size in sizes:
        bin_, had = tree.take(size)
        placed.append((bin_, length - had))
    return placed


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids and the closing
    id 1; null and empty texts are that one id. Sequences hold at most ``length`` ids. Rows that repeat an id are
    packed as documents of their own, null ids like others; an empty table gives no rows; other columns are ignored. Groups
    are drawn row by row, so neither a repeated id nor a text of very many pieces fills one. Texts of any length are cut, never shortened.
    """
    groups = max(1, -(-text_batches(docs).count() // group))
    cut = pieces(docs, tokenizer, length).withColumn("_group", F.pmod(F.xxhash64("line", F.lit(seed)), F.lit(groups))).drop("line")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        placed = np.array(first_fit_decreasing(rows["length"].tolist(), length), dtype=np.int64).reshape(-1, 2)
        rows["sequence_id"] = (int(key[0]) << 32) + placed[:, 0]
        rows["offset"] = placed[:, 1]
        return rows.drop(columns="_group")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("_group").applyInPandas(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
