"""8x8 pictures as 64-bit masks: bit ``row*8+col``, so bit 63 makes a mask negative. Masks are never compared with < or >."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8
FULL = -1


def pack(pixels: Column) -> Column:
    """A mask from 64 values; a bit is set where the value is above 0."""
    places = F.sequence(F.lit(0), F.lit(63))
    bit = F.zip_with(pixels, places, lambda p, i: F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def unpack(mask: Column) -> Column:
    """64 values of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i).cast("int"))


def pixel(mask: Column, row: Column, col: Column) -> Column:
    return F.getbit(mask, row * SIDE + col).cast("int")


def mirrored(mask: Column) -> Column:
    """The mask with each row reversed. Three swaps of neighbouring bits, pairs and nibbles, without a loop over pixels."""
    for shift, low in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        up = F.shiftleft(mask.bitwiseAND(F.lit(low).cast("bigint")), shift)
        mask = up.bitwiseOR(F.shiftrightunsigned(mask, shift).bitwiseAND(F.lit(low).cast("bigint")))
    return mask


def occupied(mask: Column) -> Column:
    return F.when(mask != 0, 1).when(mask.isNotNull(), 0)


def solid(mask: Column) -> Column:
    """The block reconstruction: a full cell wherever any pixel is set."""
    return F.when(mask != 0, F.lit(FULL)).when(mask.isNotNull(), 0).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Pixels in both by pixels in either; 1.0 for two blank masks."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / either)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
