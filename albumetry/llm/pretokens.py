"""Splitting texts exactly as a tokenizer library does, and tables of pieces already encoded.

What counts as a letter, a number or white space hangs on the Unicode version that a library was built with. The classes
are therefore asked of the library itself, once and on the driver: it matches one class against all code points. The
pattern is then compiled with these ranges in place of its class names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

CLASSES = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\s"}
Ranges = list[tuple[int, int]]
PIECES_KEPT = 500_000  # encoded pieces a worker remembers before it starts anew
LETTERS_KEPT = 1 << 24  # and their letters


def _all_letters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def ranges_of(letters: Iterable[str]) -> Ranges:
    """Runs of consecutive code points, first and last."""
    codes = np.unique(np.fromiter(map(ord, letters), dtype=np.int64))
    if not len(codes):
        return []
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return list(zip(codes[np.append(0, cuts + 1)].tolist(), codes[np.append(cuts, len(codes) - 1)].tolist()))


@lru_cache(maxsize=None)
def tiktoken_classes() -> dict[str, Ranges]:
    """Classes as the tiktoken library knows them: a vocabulary of single bytes gives back what a pattern matches."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def members(name: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        return bytes(probe.encode_ordinary(_all_letters())).decode()

    return {name: ranges_of(members(name)) for name in CLASSES}


@lru_cache(maxsize=None)
def tokenizers_classes() -> dict[str, Ranges]:
    """Classes as the tokenizers library knows them: a splitter that drops all but the matches gives them back."""
    from tokenizers import Regex, pre_tokenizers

    letters = _all_letters()

    def members(name: str) -> str:
        probe = pre_tokenizers.Split(Regex(f"{name}+"), behavior="removed", invert=True)
        return "".join(s for a in range(0, len(letters), 4096) for s, _ in probe.pre_tokenize_str(letters[a: a + 4096]))

    return {name: ranges_of(members(name)) for name in CLASSES}


@lru_cache(maxsize=None)
def composed_otherwise() -> Ranges:
    """Code points that the tokenizers library composes otherwise than Python does: younger than either's tables.

    Unassigned ones, and marks that the library does not put in order after one or before another mark.
    """
    import unicodedata

    from tokenizers import normalizers

    compose = normalizers.NFC().normalize_str

    def differs(c: str) -> bool:
        if unicodedata.category(c) == "Cn":
            return True
        return any(compose(t) != unicodedata.normalize("NFC", t) for t in (f"a{c}", f"{c}\u0334", f"\u0345{c}"))

    found = ranges_of(c for c in _all_letters() if differs(c))
    return [r for a, b in found for r in ([(a, b)] if (a < 1 << 16) == (b < 1 << 16) else [(a, 0xFFFF), (1 << 16, b)])]


def with_ranges(pattern: str, classes: dict[str, Ranges], top: int) -> str:
    r"""The pattern with ranges up to ``top`` in place of \p{L}, \p{N}, \s and \S, in brackets or outside."""
    inner = {name: "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in found if a <= top) for name, found in classes.items()}
    out, bracket = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part in inner:
            out.append(inner[part] if bracket else f"[{inner[part]}]")
        elif part == r"\S":
            out.append(f"[^{inner[chr(92) + 's']}]")
        else:
            bracket = part == "[" or (bracket and part != "]")
            out.append(part)
    return "".join(out)


class Splitter:
    """All matches of a pattern in a text, with the given classes.

    Texts whose code points all lie below 2^16 take a pattern cut off there, as ``re`` looks further ranges up one by one.
    """

    def __init__(self, pattern: str, classes: dict[str, Ranges]):
        self.low = re.compile(with_ranges(pattern, classes, 0xFFFF)).findall
        self.high = re.compile(with_ranges(pattern, classes, 0x10FFFF)).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.low(text) if text.isascii() or not self.beyond(text) else self.high(text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class PieceIds(dict):
    """Numbers of the pieces met so far; the ids of number i are ``flat[starts[i]:starts[i + 1]]``."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        super().__init__()
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.flat, self.starts, self.letters = array("I"), array("q", [0]), 0

    def _learn(self, pieces: list[str]) -> None:
        for piece, ids in zip(pieces, self.encode(pieces)):
            self[piece] = len(self.starts) - 1
            self.flat.extend(ids)
            self.starts.append(len(self.flat))
            self.letters += len(piece)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Number of every piece; they hold until the next call."""
        if len(self) > PIECES_KEPT or self.letters > LETTERS_KEPT:
            self._empty()
        if new := [p for p in set(pieces) if p not in self]:
            self._learn(new)
        return np.fromiter(map(self.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def ids(self, pieces: list[str]) -> np.ndarray:
        """Ids of all pieces in order, unsigned 32-bit."""
        if not pieces:
            return np.zeros(0, dtype="<u4")
        numbers = self.numbers(pieces)
        # the result is a copy: an array under a view cannot grow
        return gathered(np.frombuffer(self.flat, dtype="<u4"), np.frombuffer(self.starts, dtype=np.int64), numbers)


def gathered(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The stretches ``flat[starts[i]:starts[i + 1]]`` of all ids, joined."""
    first, sizes = starts[ids], starts[ids + 1] - starts[ids]
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0].copy()
    at = np.repeat(first - (ends - sizes), sizes)
    at += np.arange(ends[-1])
    return flat[at]
