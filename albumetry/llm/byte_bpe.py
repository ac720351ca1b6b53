"""Byte-level BPE by a sentencepiece model written from the vocabulary.

The vocabulary is a file of byte strings and ranks. Each byte string becomes a piece, every byte a printable letter of
its own, scored by the negative of its rank: the best-scored merge is then the merge of lowest rank, the leftmost first. The
model is serialised here, field by field, with the identity as its normalisation, so that nothing is trained or changed.
Texts are cut into pre-tokens by the vocabulary's pattern; a pre-token that is itself a byte string of the vocabulary is
its id, any other is encoded by the model. Decoding joins the byte strings of the ids.

Each worker builds the model once from the file and remembers the pre-tokens it has encoded, up to a bound.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry.llm.pretokens import PieceIds, Ranges, Splitter, byte_letters, gathered, tiktoken_classes

UNKNOWN = "\u2047unknown"  # holds letters that stand for no byte
BETWEEN = "\u2016"  # stands for no byte either
# Field numbers and values of the model format (fixed values).
PIECE, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE_BPE, TYPE_UNKNOWN = 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a vocabulary file: a base64 string and a number per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def model_bytes(tokens: list[bytes], letters: list[str]) -> bytes:
    """A sentencepiece BPE model whose piece k is token k, and a last one for the unknown, which no text reaches."""
    out = []
    for k, token in enumerate(tokens):
        out.append(_block(PIECE, _block(1, "".join(letters[b] for b in token).encode()) + _float(2, -k)))
    out.append(_block(PIECE, _block(1, UNKNOWN.encode()) + _float(2, 0) + _number(3, TYPE_UNKNOWN)))
    # model type, number of pieces, ids of unknown, begin, end and padding (none), the unknown piece
    out.append(_block(TRAINER, _number(3, MODEL_TYPE_BPE) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
                      + _number(41, -1) + _number(42, -1) + _number(43, -1) + _block(45, UNKNOWN.encode())))
    # identity: no table, no space in front, no space removed or replaced
    out.append(_block(NORMALIZER, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str, classes: dict[str, Ranges]):
        import sentencepiece

        ranks = read_ranks(path)
        tokens = sorted(ranks, key=ranks.get)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        letters = byte_letters()
        self.ranks, self.letters = ranks, {b: c for b, c in enumerate(letters)}
        self.rank_of = np.array([ranks[t] for t in tokens])
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(tokens, letters))
        self.split = Splitter(pattern, classes)
        self.known = PieceIds(self._encode)
        # byte strings by rank, joined
        sizes = np.zeros(self.rank_of.max() + 2, dtype=np.int64)
        sizes[self.rank_of + 1] = [len(t) for t in tokens]
        self.starts = np.cumsum(sizes)
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found = [self.ranks.get(r) for r in raw]
        rest = [r.decode("latin-1").translate(self.letters) for r, whole in zip(raw, found) if whole is None]
        # one call for all: no merge crosses a letter that no piece holds, and it leaves the unknown id between them
        ids = np.array(self.model.encode(BETWEEN.join(rest)), dtype=np.int64) if rest else np.zeros(0, dtype=np.int64)
        cuts = np.flatnonzero(ids == len(self.rank_of))
        ranks = self.rank_of[np.where(ids < len(self.rank_of), ids, 0)].tolist()
        spans = iter(zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ranks)]))
        return [ranks[slice(*next(spans))] if whole is None else [whole] for whole in found]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, unsigned 32-bit."""
        return self.known.ids(self.split(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return gathered(self.flat, self.starts, ids).tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, classes: dict[str, Ranges]) -> Codec:
    """One per worker process, kept between tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern, classes)
    return _codecs[path, pattern]


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column by the ranks in ``path``, as bytes: unsigned 32-bit numbers, lowest byte first.

    Equal to the ids of the tiktoken library without special tokens. A null or empty text has no ids (no bytes). Texts of any
    length are encoded whole. Column names, ties and repeated rows are of no account, as each row stands for itself.
    """
    classes = tiktoken_classes()

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern, classes)
        for batch in texts:
            yield pd.Series([own.encode(t).tobytes() if isinstance(t, str) else b"" for t in batch], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids (in the form of ``encoded``) stand for; null and empty ids give no bytes.

    An id beyond the vocabulary raises an error.
    """
    classes = tiktoken_classes()

    @F.pandas_udf("binary")
    def decode(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pattern, classes)
        for batch in rows:
            yield pd.Series([own.decode(np.frombuffer(r or b"", dtype="<u4")) for r in batch], dtype=object)

    return decode(ids)
