"""Hash expressions that give the same numbers everywhere: folds, units of removal, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(c: Column, k: int) -> Column:
    """md5's first eight bytes, read little-endian, mod k: the fold of an id."""
    h = F.md5(c.cast("binary"))
    swapped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(k)).cast("int")


def md5_unit(c: Column, salt: str = "") -> Column:
    """The whole md5 of id and salt as a number, mod 1000, over 1000."""
    h = F.md5(F.concat(c, F.lit(salt)).cast("binary"))
    high, low = (F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") % F.lit(1000) for at in (1, 17))
    return (((high * F.lit(pow(2, 64, 1000)) + low) % F.lit(1000)).cast("int") / F.lit(1000)).cast("double")


def uniform(*c: Column) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*c), F.lit(1_000_003)) / F.lit(1_000_003.0)
