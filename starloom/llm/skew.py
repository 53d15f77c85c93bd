"""Joins on keys that may each hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that are split; a key with more than this part of all rows is one of them, so they are always fewer.
SPLIT_KEYS = 20_000
#: Least rows of a key that is split.
LEAST = 5_000


def parts_of(counts: DataFrame, key: str, count: str, total: int) -> DataFrame | None:
    """(key, parts) of the keys that are to be split, or None; ``total`` is the sum of the counts or more.

    A key is split if it has more rows than ``LEAST`` and than a ``SPLIT_KEYS``-th of all, so this
    table has no more than ``SPLIT_KEYS`` rows whatever the size of the input, and can be broadcast.
    """
    most = max(LEAST, total // SPLIT_KEYS)
    rows = counts.where(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("long").alias("parts")).collect()
    return counts.sparkSession.createDataFrame(rows, f"{key} long, parts long") if rows else None


def with_parts(df: DataFrame, key: str, parts: DataFrame | None) -> DataFrame:
    """Add ``parts``: 1 for keys that are not split."""
    if parts is None:
        return df.withColumn("parts", F.lit(1).cast("long"))
    named = F.broadcast(parts.select(F.col(key).alias("_key"), F.col("parts").alias("_parts")))
    return df.join(named, F.col(key) == F.col("_key"), "left").withColumn("parts", F.coalesce("_parts", F.lit(1).cast("long"))).drop("_key", "_parts")


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, of which each key has one row; both have ``parts``, the same for a key.

    The rows of a key are dealt, by a hash of ``by``, over as many copies of its row. Only the ``parts`` of ``many`` stays.
    """
    turn: Column = F.pmod(F.xxhash64(by), F.col("parts"))
    copies = one.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return many.withColumn("_part", turn).join(copies, [key, "_part"], how).drop("_part")
