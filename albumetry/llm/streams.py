"""Helpers for Arrow-batched steps: whole groups from sorted batches, fixed-size bitmaps of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 23  # 1 MB; ids beyond what fits make it pass more rows, never fewer


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut so that no group is split: (rows, start of each group). The rows must come sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), dtype=bool)
        for k in keys:
            last &= batch[k].to_numpy() == batch[k].iloc[-1]
        cut = len(batch) - int(last[::-1].argmin()) if not last.all() else 0
        if last.all():
            same = not held or all(held[-1][k].iloc[-1] == batch[k].iloc[-1] for k in keys)
            if not same:
                yield _with_starts(pd.concat(held), keys)
                held = []
            held.append(batch)
            continue
        yield _with_starts(pd.concat([*held, batch.iloc[:cut]]), keys)
        held = [batch.iloc[cut:]]
    if held:
        yield _with_starts(pd.concat(held), keys)


def _with_starts(rows: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return rows.reset_index(drop=True), np.flatnonzero(new)


def bit_of(c: str | Column, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << bits))


def bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits of the ids' hashes, 2^bits of them whatever the number of ids; summed up by Spark in 4 kB rows."""
    at = ids.select((bit_of(column, bits) + 1).alias("p"))  # the functions count from 1
    rows = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("b"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in rows.collect():  # at most 2^bits / 32768 rows
        out[(r["n"] - 1) * 4096: r["n"] * 4096] = np.frombuffer(r["b"], dtype=np.uint8)
    return out


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bit numbers are set."""
    at = at.astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of 0 .. n - 1 over the edges a - b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label
