"""Deterministic, partition-independent randomness.

Every random choice is an 8-hex-digit string derived from md5(seed|purpose|key...).
Comparing and ordering these strings replaces rand(): the outcome depends on the row
only, never on how rows are spread over partitions or on retries of a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "7"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def u8(purpose: str, *keys) -> Column:
    """Uniform 8-hex-digit string for a purpose and a row key."""
    parts = [F.lit(f"{SEED}|{purpose}")] + [_c(k).cast("string") for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)


def threshold(p: float) -> str:
    """Hex string t such that P(u8 < t) = p; p = 1 gives a string above every u8."""
    return "g" if p >= 1 else f"{int(p * 2**32):08x}"


def chance(u: Column, p: float) -> Column:
    """True with probability p."""
    return u < F.lit(threshold(p))


def u_int(u: Column) -> Column:
    """The hash string as a BIGINT in [0, 2^32)."""
    return F.conv(u, 16, 10).cast("bigint")


def pick_index(u: Column, n) -> Column:
    """Uniform 0-based index below n, for lists; NULL for an empty one."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(u_int(u), F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))).cast("int")


def place(purpose: str, *keys) -> Column:
    """Uniform BIGINT below 2^60 for a purpose and a row key: the start in a table of any size, modulo its rows."""
    parts = [F.lit(f"{SEED}|{purpose}")] + [_c(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def hash_sort(arr: Column, purpose: str, *keys) -> Column:
    """The elements of a string array in a hashed order that depends on (purpose, keys, element)."""
    tagged = F.transform(arr, lambda x: F.struct(u8(purpose, *keys, x).alias("u"), x.alias("v")))
    return F.transform(F.array_sort(tagged), lambda s: s["v"])
