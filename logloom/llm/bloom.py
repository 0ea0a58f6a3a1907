"""A blocked Bloom filter as a table, made and asked with built-in functions only.

A block is four 64-bit words with two bits of each key; a key's block and bits come from two
hashes. The table is broadcast, so it has at most BLOCKS rows of 40 bytes (10 MB). From 16 bits a
key it goes down to LEAST; for more keys than that it would let nearly everything pass, so there
is no table and every row passes. Each user of the filter joins exactly behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import quoted, renamed

BITS_A_KEY, LEAST, BLOCKS = 16, 5, 1 << 18


def _mask(key: Column) -> list[Column]:
    """The key's four words: in each, two bits told by six bits of a hash."""
    h, one = F.xxhash64(F.lit(2), key), F.lit(1).cast("long")

    def bit(by: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63).cast("long")).cast("int"))

    return [bit(12 * k).bitwiseOR(bit(12 * k + 6)) for k in range(4)]


class Bloom:
    def __init__(self, keys: DataFrame, key: str, n_keys: int) -> None:
        """Of the values of ``key`` in ``keys``; nulls never pass. ``n_keys``, about their number, sizes the filter."""
        self.blocks, self.rows = 1, None
        while self.blocks < BLOCKS and self.blocks * 256 < n_keys * BITS_A_KEY:
            self.blocks *= 2
        if self.blocks * 256 >= n_keys * LEAST:
            c = F.col(quoted(key))
            words = keys.where(c.isNotNull()).select(self._block(c).alias("_fb"), *[w.alias(f"_w{k}") for k, w in enumerate(_mask(c))])
            self.rows = words.groupBy("_fb").agg(*[F.expr(f"bit_or(_w{k})").alias(f"_w{k}") for k in range(4)])

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def marked(self, df: DataFrame, key: str, flag: str) -> DataFrame:
        """``df`` with the boolean ``flag``, a new name: whether the row's ``key`` may be among the keys."""
        if self.rows is None:
            return df.withColumn(flag, F.col(quoted(key)).isNotNull())
        own, back = renamed(df)
        c = F.col(back[key])
        hit = c.isNotNull()
        for k, m in enumerate(_mask(c)):
            hit = hit & (F.col(f"_w{k}").bitwiseAND(m) == m)
        out = own.withColumn("_fb", self._block(c)).join(F.broadcast(self.rows), "_fb", "left")
        return out.select(*[F.col(c).alias(name) for name, c in back.items()], F.coalesce(hit, F.lit(False)).alias(flag))

    def passed(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` whose ``key`` may be among the keys."""
        if self.rows is None:
            return df.where(F.col(quoted(key)).isNotNull())
        own, back = renamed(df)
        c = F.col(back[key])
        out = own.where(c.isNotNull()).withColumn("_fb", self._block(c)).join(F.broadcast(self.rows), "_fb")
        for k, m in enumerate(_mask(c)):
            out = out.where(F.col(f"_w{k}").bitwiseAND(m) == m)
        return out.select(*[F.col(c).alias(name) for name, c in back.items()])
