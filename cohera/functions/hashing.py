"""Deterministic md5 ranks: the only source of randomness in the library.

A rank is ``md5(concat_ws('|', seed, key...))``; comparing hex strings orders
rows, and the first 8 hex digits give a non-negative integer in [0, 2^32).
The same expressions exist in ANSI-ish SQL engines, so sampled results can be
checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def md5_key(seed, *parts) -> Column:
    """Hex md5 of ``seed|part1|part2...`` (all parts rendered as strings)."""
    return F.md5(F.concat_ws("|", _c(str(seed)), *[_c(p).cast("string") for p in parts]))


def hex_to_int(h: Column, digits: int = 8) -> Column:
    """Integer value of the first ``digits`` hex chars of ``h``."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def md5_int(seed, *parts) -> Column:
    return hex_to_int(md5_key(seed, *parts))
