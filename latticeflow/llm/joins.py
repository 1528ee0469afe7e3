"""Joins of fingerprints, of which a few may be held by a large share of both sides, and bitmaps of bounded size that tell which are wanted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.session import cut

#: Rows of one fingerprint on one side that go to one task.
HOT = 2000
#: Most bits of a bitmap (32 MB); more entries make it let more through, which costs time but changes nothing.
MOST_BITS = 28
#: Bits of one of Spark's bitmaps.
_PAGE = 15


def grid_join(left: DataFrame, right: DataFrame, key: str, hot: int | None = None) -> DataFrame:
    """The equi-join of both tables on `key`, which is not null; the other columns must differ in name.

    A key with more than `hot` rows on a side is cut into parts of that many on this side, and the other side's rows are copied to each
    part: a grid of tasks, none of which sees more than about `hot` rows of a side. All other keys are joined as they are.
    """
    hot = hot or HOT
    sides = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    parts = lambda c: F.ceil(F.col(c) / hot).cast("int")
    many = cut(sides.where((F.col("_l") > hot) | (F.col("_r") > hot)).select(key, parts("_l").alias("_nl"), parts("_r").alias("_nr")))
    if many.isEmpty():
        return left.join(right, key)

    def placed(df: DataFrame, own: str, other: str, mine: str, its: str) -> DataFrame:
        hashed = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.coalesce(F.col(own), F.lit(1)).cast("long")).cast("int").alias(mine)
        return df.join(many, key, "left").select(*df.columns, hashed, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(its))

    return placed(left, "_nl", "_nr", "_pl", "_pr").join(placed(right, "_nr", "_nl", "_pr", "_pl"), [key, "_pl", "_pr"]).drop("_pl", "_pr")


def bitmap(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """(bytes, bits): a bitmap of a column of 64-bit hashes with about 16 bits to an entry, at most 2 ** MOST_BITS in all.

    Its pages are made in Spark and put together on the driver; the bound holds whatever the table's size.
    """
    n = hashes.count()
    bits = min(MOST_BITS, max(_PAGE, (16 * n).bit_length()))
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    pages = hashes.groupBy(F.shiftright(at, _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << _PAGE) - 1)).alias("bits")).collect()  # at most 2 ** (MOST_BITS - 15) pages of 4 kB
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in pages:
        out[r["page"] << (_PAGE - 3) : (r["page"] + 1) << (_PAGE - 3)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def in_bitmap(hashes: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """1 for each unsigned hash that may be in the bitmap, 0 for those that are not."""
    low = hashes & np.uint64((1 << width) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
