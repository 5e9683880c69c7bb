"""A bitmap of bounded size that tells which rows cannot have a partner in a join, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the bits that Spark's bitmap aggregate holds in one bitmap.
BITS = 1 << 15


def _slot(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def split(df: DataFrame, on: Column, keys: DataFrame, key: str, size: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose `on` may be among keys.key, and those whose is surely not.

    The bitmap has `size` bits, 4 MB with the default, whatever the number of keys, so it may be broadcast. The more keys
    there are, the more rows pass that have none; no row that has one ever fails to pass. A null never has one."""
    slot = _slot(F.col(key), size)
    bitmaps = keys.where(F.col(key).isNotNull()).groupBy(F.shiftright(slot, 15).alias("_bitmap")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(BITS))).alias("_bits"))
    own = F.coalesce(_slot(on, size), F.lit(-1))
    at = F.pmod(own, F.lit(BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False)) & on.isNotNull()
    told = df.join(F.broadcast(bitmaps), F.shiftright(own, 15) == F.col("_bitmap"), "left")
    columns = [df[c] for c in df.columns]
    return told.where(may).select(*columns), told.where(~may).select(*columns)
