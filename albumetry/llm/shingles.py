"""Word shingles of whole texts as 64-bit hashes, a batch at a time.

The bytes of many texts lie in one array. Cumulative sums of byte * B^position (mod 2^64) give the hash of any run of
bytes from two entries, so hashing words and shingles costs a few passes over the bytes and no Python step per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
LONG = 64  # bytes of a word from which on it is hashed alone
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be undone
# Lower case of A-Z only; words end at \x20 and \x09 to \x0D.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(B^0 .. B^n, B^-0 .. B^-n) mod 2^64, kept by the worker."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            up = np.full(size + 1, BASE, dtype=np.uint64)
            up[0] = 1
            down = np.full(size + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
            down[0] = 1
            _powers.update(up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative hash of bytes, or of 64-bit codes; the run [i, j) has hash ``run_hash(prefix, i, j)``."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    codes = BYTE_CODES[data] if data.dtype == np.uint8 else data.copy()
    codes *= up[: len(data)]
    np.cumsum(codes, out=out[1:], dtype=np.uint64)
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte runs, equal for equal runs wherever they lie (lengths are hashed in)."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words. Sums of powers mod 2^64 are equal for some different long runs (Thue-Morse words), so long words,
    which are few, have a digest of their bytes."""
    hashes = run_hash(prefix_hash(data), start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_codes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of all words of each text, in order and as they are written."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    start, end = word_bounds(data)
    hashes = word_hashes(data, start, end)
    return np.split(hashes, np.searchsorted(start, np.cumsum(sizes)[:-1]))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``words`` words has one shingle, all its words; without words or text, none.
    """
    raw = b"\n".join(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts) + b"\n"
    sizes = [len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) and not t.isascii() else len(t) if isinstance(t, str) else 0
             for t in texts]
    ends_of = np.cumsum(np.array(sizes, dtype=np.int64) + 1)
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    hashes = word_hashes(data, start, end)
    first = np.searchsorted(start, np.concatenate(([0], ends_of[:-1])))
    last = np.searchsorted(start, ends_of)
    # a shingle is a fixed combination of its words' hashes
    up, _ = powers(words)
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += mixed(hashes[k: len(hashes) - words + 1 + k] + np.uint64(k)) * up[k + 1]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a: b - words + 1]))
        elif b > a:
            few = sum((mixed(hashes[a + k: a + k + 1] + np.uint64(k)) * up[k + 1] for k in range(b - a)), np.zeros(1, np.uint64))
            out.append(mixed(few + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def chunks(texts: list, limit: int = 1 << 19) -> Iterator[tuple[int, list]]:
    """(first row, texts) with about ``limit`` characters each, or one longer text."""
    at, size, first = [], 0, 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if at and size + n > limit:
            yield first, at
            at, size, first = [], 0, k
        at.append(t)
        size += n
    if at:
        yield first, at
