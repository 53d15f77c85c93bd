"""Bounded samples to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The distinct values of ``key`` (one column of that name), at most ``n``, that come first by hash.

    A count gives a bound of the hash under which about twice as many rows lie, so that a table of any size
    sends a few rows on, not its first ``n`` of every partition. Repeats of a value count once, and may leave fewer than ``n``.
    """
    h = F.xxhash64(key)
    total = rows.count()
    if total > 2 * n:
        rows = rows.where(h < F.lit(-(1 << 63) + int((1 << 64) * (2.0 * n / total))))
    return rows.select(key).distinct().orderBy(h, key).limit(n)
