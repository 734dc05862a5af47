"""Reproducible random numbers: hashes of what they are drawn for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw32(*parts: Column, method: str = "md5") -> Column:
    """A whole number from 0 to 2^32 - 1 that depends on the parts only.

    `md5` can be recomputed by any SQL engine; `xxhash64` is faster.
    """
    if method == "md5":
        return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*parts), 32)
    raise ValueError("method must be md5 or xxhash64")
