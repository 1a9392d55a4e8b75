"""Samples by hash whose chances hold at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes are cut to this many bits, as many as a long has without its sign.
BITS = 63


def threshold(wanted: int, total: int) -> int:
    """Hashes of BITS bits up to this one are about ``wanted`` of ``total`` rows; in integers, so that it doesn't round to none for any number of rows."""
    return (1 << BITS) - 1 if wanted >= total else (wanted << BITS) // total


def chosen(most: int | Column, *cols: Column | str, seed: int = 0) -> Column:
    """Whether a row's hash of ``cols`` is within a threshold."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 64 - BITS) <= most
