"""Integer logarithms, bit fields and lexicographic order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_up(x: Column) -> Column:
    """Smallest k with 2^k >= x, exact; 0 for x <= 1."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x.cast("bigint") - 1))).cast("bigint")


def bit_field(x: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(x, shift).bitwiseAND((1 << bits) - 1)


def spread_bits(x: Column, gap: int, bits: int) -> Column:
    """The lowest ``bits`` bits of x with ``gap`` zeros between them."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("bigint"), i).bitwiseAND(1), i * (gap + 1)))
    return out


def not_after(a: list[Column], b: list[Column]) -> Column:
    """Lexicographic a <= b."""
    return F.struct(*a) <= F.struct(*b)


def hash64(*cols: Column) -> Column:
    return F.xxhash64(*cols)
