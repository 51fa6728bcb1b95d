"""Bloom filters of bounded size, made by a grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = 0x5BD1E995  # odd, below 2**31


class Bloom:
    """A set of 32-bit hashes, two bits set for each, in ``bits`` bits (a power of two, 64 to 2**27)."""

    def __init__(self, hashes: DataFrame, column: Column, bits: int):
        low = column.bitwiseAND(F.lit(0xFFFFFFFF))
        second = F.shiftright((low * F.lit(_SPREAD)).bitwiseAND(F.lit(0xFFFFFFFF)), 5)
        place = F.explode(F.array(low, second)).alias("place")
        place_low = F.col("place").bitwiseAND(F.lit(bits - 1))
        words = hashes.select(place).groupBy(F.shiftright(place_low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("marks")).toArrow()
        self.bits, self.marks = bits, np.zeros(bits // 64, np.int64)  # at most bits / 64 rows came
        self.marks[words.column("word").to_numpy()] = words.column("marks").to_numpy()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of an array of 64-bit hashes may be in it, by their low halves."""
        low = hashes.view(np.int64) & 0xFFFFFFFF
        found = np.ones(len(low), bool)
        for x in (low, ((low * _SPREAD) & 0xFFFFFFFF) >> 5):
            x = x & (self.bits - 1)
            found &= (self.marks[x >> 6] >> (x & 63)) & 1 == 1
        return found


def bits_for(n: int, most_bits: int) -> int:
    """Sixteen bits an entry, to a power of two, within 2**16 and ``most_bits``."""
    return min(most_bits, max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()))


def sifted(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str, most_bits: int = 1 << 27) -> DataFrame:
    """``rows`` without most of those whose ``column`` is no value of ``wanted``.

    A join must follow: some rows come through by accident. None that is wanted
    is lost; null is a value like others. What the driver and each task hold is
    at most ``most_bits`` bits (16 MB). With more than ``most_bits`` / 4 wanted
    rows the filter would hold little back and is left out: all rows come back.
    """
    n = wanted.count()
    if n > most_bits // 4:
        return rows
    shared = rows.sparkSession.sparkContext.broadcast(Bloom(wanted, F.xxhash64(wanted_column), bits_for(n, most_bits)))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(hashes.to_numpy()))

    return rows.where(maybe(F.xxhash64(column)))
