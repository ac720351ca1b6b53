"""Statistics of grey rasters as column expressions: no Python worker reads a pixel.

A raster is kept as packed numbers of eight bytes, and one row per pixel reads its neighbours from there. Spark compiles such rows
into one loop; a lambda over an array is interpreted for each pixel and costs many times as much.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry.functions.text import let


STEP = 6  # bytes from one packed number to the next: each of them has both its neighbours in the number


def packed(data: Column) -> Column:
    """Bytes of a binary column as numbers of eight bytes, the first on top: number k holds bytes 6k - 1 to 6k + 6, zeros outside."""
    numbers = F.ceil(F.octet_length(data) / STEP).cast("int")
    zero = F.lit(bytearray(1))

    def cut(full: Column) -> Column:
        number = lambda k: F.conv(F.hex(F.substring(full, STEP * k + 1, F.lit(8))), 16, -10).cast("long")
        return F.transform(F.sequence(F.lit(0), numbers - 1), number)

    return let(F.rpad(F.concat(zero, data), (STEP * numbers + 2).cast("int"), zero), cut)


def triple(numbers: Column, i: Column) -> Column:
    """Byte ``i`` of packed numbers with its neighbours, as the three lowest bytes of a number; null far outside."""
    k = F.floor(i / STEP).cast("int")
    return F.call_function("shiftrightunsigned", F.get(numbers, k), 40 - 8 * (i - STEP * k))


def _byte(three: Column, place: int) -> Column:
    return F.shiftright(three, 8 * place).bitwiseAND(255).cast("int")


def level(three: Column) -> Column:
    """Byte in the middle, 0 to 255."""
    return _byte(three, 1)


def edge_level(above: Column, here: Column, below: Column, at: Column, row: Column, width: Column, height: Column) -> Column:
    """3×3 edge filter (centre 8, neighbours -1) held in 0 to 255, from the triples of three rows; the border stays as it is; null without a pixel."""
    border = (at == 0) | (at == width - 1) | (row == 0) | (row == height - 1)
    box = sum((_byte(three, place) for three in (above, here, below) for place in range(3)), F.lit(0))
    return F.when(border, level(here)).when(~border, F.least(F.lit(255), F.greatest(F.lit(0), 9 * level(here) - box)))


def sums(x: Column) -> Column:
    """Number, sum and sum of squares of a column of whole numbers, as an aggregate; nulls are left out."""
    return F.struct(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def deviation(s: Column) -> Column:
    """Standard deviation from ``sums``, with whole numbers up to the root."""
    return F.sqrt((s["n"] * s["q"] - s["s"] * s["s"]).cast("double")) / s["n"]


def rounded(x: Column, digits: int) -> Column:
    """Half up on the double ``x`` times 10^digits, as the SQL rounds; ``round`` alone goes by the shortest decimal form of ``x``, which
    can end in a tie where the product does not, or the other way round."""
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def inner(at: Column, row: Column, width: Column, height: Column) -> Column:
    """Whether a pixel is left when the outermost ones go: two, or fewer on small rasters."""
    m = F.least(F.lit(2), F.shiftright(width, 2), F.shiftright(height, 2))
    return (at >= m) & (at < width - m) & (row >= m) & (row < height - m)
