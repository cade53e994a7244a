"""Seeded randomness that any SQL engine can repeat: md5 over ids, never ``rand``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def _column(part) -> Column:
    if isinstance(part, Column):
        return part
    return F.col(part) if isinstance(part, str) else F.lit(part)


def hash32(*parts) -> Column:
    """First 8 hex digits of md5 over the dash-joined parts: a long in [0, 2**32).

    Strings name columns; numbers are literals (seed, salt, epoch).
    """
    joined = F.concat_ws("-", *[_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(*parts) / F.lit(float(HASH_RANGE))
