"""Bloom filters of keys as small tables of bitmaps, made and tested by built-in functions.

A filter of ``bits`` bits has a row for each 32,768 of them (bucket, bitmap), so its size is known beforehand, whatever it was made
from: 2**24 bits are 512 rows and 2 MB. Two hashes place a key. A key that was put in is always found; others are found
by chance, the more of them the fuller the filter is. A filter is merged with another one of the same size by ``merged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 15  # bits of a bitmap, fixed by Spark


def _place(key: str, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits))


def key_filter(df: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """(bucket, bitmap) of the keys of ``df``; null keys are left out."""
    places = df.where(F.col(key).isNotNull()).select(F.explode(F.array(*[_place(key, seed, bits) for seed in (1, 2)])).alias("place"))
    return places.groupBy(F.floor(F.col("place") / PIECE).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % PIECE).alias("bitmap"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of the given ones."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def with_may_hold(df: DataFrame, key: str, known: DataFrame, bits: int = 1 << 24, name: str = "may_hold") -> DataFrame:
    """``df`` with whether the filter may hold its key; false is certain. The filter, of ``bits`` / 8 bytes, is broadcast."""
    out, tests = df, []
    for seed in (1, 2):
        place = _place(key, seed, bits)
        part = known.select(F.col("bucket").alias(f"__bucket{seed}"), F.col("bitmap").alias(f"__bits{seed}"))
        out = out.join(F.broadcast(part), F.floor(place / PIECE) == F.col(f"__bucket{seed}"), "left")
        at = (place % PIECE).cast("int")
        byte = F.conv(F.hex(F.col(f"__bits{seed}").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.pmod(F.shiftrightunsigned(byte, 0) / F.pow(F.lit(2), at % 8).cast("int"), F.lit(2)) >= 1, F.lit(False)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (tests[0] & tests[1]).alias(name))
