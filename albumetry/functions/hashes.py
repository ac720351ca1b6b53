"""Content and perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.text import let

VALID_HASH = "^[0-9a-fA-F]{16}$"


def hash_bits(hex16: Column) -> Column:
    """16 hex digits → signed 64-bit integer; anything else → null."""
    # the hash may be a long computation: once per row, not once for the test and once for the number
    return let(hex16, lambda h: F.when(h.rlike(VALID_HASH), F.conv(h, 16, -10).cast("long")))


def bits_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Distance of two hex hashes; 999 where missing or of unequal length."""
    usable = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(usable, F.coalesce(bit_distance(hash_bits(a), hash_bits(b)), F.lit(999))).otherwise(999)


def ahash64(grid: Column) -> Column:
    """Mean-threshold hash of an 8×8 grey grid, first pixel in the top bit."""
    def packed(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x)
        return let(
            total,
            lambda t: F.aggregate(
                g,
                F.lit(0).cast("long"),
                lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x * 64 >= t).cast("long")),
            ),
        )

    return bits_hex(let(grid, packed))


def dhash64(grid: Column) -> Column:
    """Left-greater-than-right hash of 8 rows of 9 grey values, first bit lowest."""

    def packed(g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = F.floor(i / 8).cast("int") * 9 + i % 8
            bit = (F.get(g, at) > F.get(g, at + 1)).cast("long")
            return acc.bitwiseOR(F.call_function("shiftleft", bit, i))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), step)

    return bits_hex(let(grid, packed))


def valid_signature(content: Column) -> Column:
    """JPEG, PNG or WebP by leading bytes."""
    head = F.hex(F.substring(content, 1, 12))
    known = (
        head.startswith("FFD8FF")
        | head.startswith("89504E47")
        | (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"))
    )
    return F.coalesce((F.length(content) >= 4) & known, F.lit(False))


def dominant_colours(r: Column, g: Column, b: Column) -> Column:
    """Colour names of a mean colour (0-255 integers), at most four."""
    options = F.array(
        *[
            F.struct(
                ((r - F.lit(pr)) * (r - F.lit(pr)) + (g - F.lit(pg)) * (g - F.lit(pg)) + (b - F.lit(pb)) * (b - F.lit(pb))).alias("far"),
                F.lit(i).alias("place"),
                F.lit(name).alias("name"),
            )
            for i, (name, pr, pg, pb) in enumerate(vocab.PALETTE)
        ]
    )
    luma = (r * 299 + g * 587 + b * 114) / 1000
    first = F.when(luma < 60, "black").when(luma > 200, "white")
    middle = F.when((luma >= 60) & (luma <= 200), "gray")
    return F.slice(
        F.array_distinct(F.array_compact(F.array(first, F.array_min(options)["name"], middle))), 1, 4
    )
