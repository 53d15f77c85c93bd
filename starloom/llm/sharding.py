"""Sharding along a Hilbert curve over metadata, for files that prune in several dimensions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from starloom.llm.names import unused
from starloom.plans.durable import durable, new_path


def hilbert(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with ``bits`` bits a coordinate (Skilling's transposed form)."""
    x = [np.asarray(c, np.int64).copy() for c in coordinates]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for c in x:
            index = (index << 1) | ((c >> b) & 1)
    return index


def text_cuts(docs: DataFrame, name: str, parts: int) -> list[str]:
    """The ``parts`` - 1 values at which the rows, in the order of a text column, pass each ``parts``-th of all.

    Rows are counted by value, the values sorted by ranges, and each range's running sum begins where the
    range before ends, so a column of any number of values is cut, by whole values whatever they begin with.
    """
    value, order = F.col(name).cast("string").alias("value"), Window.partitionBy("part").orderBy("value")
    counts = docs.select(value).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    placed = durable(counts.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value").withColumn("part", F.spark_partition_id()), "values")
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("n")).collect()):  # one row per range
        starts.append((part, total))
        total += n
    if not total:
        return []
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, start long"))
    after = placed.join(offsets, "part").withColumn("after", F.col("start") + F.sum("n").over(order))
    step = lambda rows: F.floor(rows * parts / total)
    passed = F.least(step(F.col("after")), F.lit(parts - 1)) - step(F.col("after") - F.col("n"))
    cuts = after.select("value", passed.alias("times")).where("times > 0").collect()
    return [r.value for r in sorted(cuts, key=lambda r: r.value.encode()) for _ in range(r.times)]


def curve_order(docs: DataFrame, dimensions: list[str], bits: int = 6) -> DataFrame:
    """Add ``curve``: each dimension cut at its own quantiles into 2**bits steps, then the Hilbert index.

    The cut points come from all rows: approximate quantiles of numbers, exact ones of text. A few values a
    dimension reach the driver whatever the input. Nulls are in the first step.
    """
    numeric = [d for d in dimensions if isinstance(docs.schema[d].dataType, NumericType)]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts: dict[str, list] = {}
    if numeric:
        found = docs.agg(*(F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(f"q{i}") for i, d in enumerate(numeric))).first()
        cuts = {d: found[i] for i, d in enumerate(numeric)}

    def step(d: str):
        value = F.col(d).cast("double") if d in numeric else F.col(d).cast("string")
        at = cuts[d] if d in numeric else text_cuts(docs, d, 1 << bits)
        if not at:
            return F.lit(0)
        return F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.lit(list(at)), lambda c: c < value)))

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert([c.to_numpy() for c in columns], bits))

    return docs.withColumn("curve", index(*map(step, dimensions)))


def hilbert_shards(docs: DataFrame, shards: int, dimensions: list[str] = ("source", "lang", "n_chars"), bits: int = 6, tie: list[str] = ("doc_id",)) -> DataFrame:
    """Order all rows along the curve and cut the order into ``shards`` runs whose lengths differ by one at most.

    Adds curve, rank (from 0), shard and slot (from 0 within the shard). The order is a range-partitioned
    sort; a row's rank is its place in its partition plus the rows of the partitions before, and only one
    count per partition reaches the driver.

    Edge cases: nulls in any dimension fall into its first step; texts take no part in the order, however long; rows equal in every sort column may change places
    with one another only; an empty table gives no row; columns named like the added ones are replaced.
    """
    docs = docs.drop("curve", "rank", "shard", "slot")
    spark = docs.sparkSession
    by = ["curve", *tie]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_no, place, begin = unused([*docs.columns, "curve", "rank", "shard", "slot", "count"], "_part", "_place", "_start")
    placed = (
        curve_order(docs, list(dimensions), bits)
        .repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn(part_no, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = durable(placed, "curve")
    counts = sorted((r[part_no], r["count"]) for r in placed.groupBy(part_no).count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = spark.createDataFrame(starts, f"{part_no} int, {begin} long")  # one row per partition
    ranked = placed.join(F.broadcast(offsets), part_no).withColumn("rank", F.col(begin) + F.col(place))
    total = max(total, 1)
    return (
        ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {total}").cast("int"))
        .withColumn("slot", F.expr(f"rank - (CAST(shard AS BIGINT) * {total} + {shards - 1}) div {shards}"))
        .drop(part_no, place, begin)
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 40, **options) -> tuple[str, DataFrame]:
    """Write the shards as Parquet, one folder a shard in curve order; returns the path and each shard's bounds.

    The bounds (rows, min and max of every dimension) are what a reader needs to skip shards.
    """
    dimensions = list(options.get("dimensions", ("source", "lang", "n_chars")))
    path = path or new_path(docs.sparkSession, "shards")
    hilbert_shards(docs, shards, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    bounds = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return path, stored.groupBy("shard").agg(F.count("*").alias("n_rows"), *bounds)


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every document."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    facts = durable(facts, "facts")  # a few dozen bytes a row: sampling and sorting do not read the texts again
    placed = hilbert_shards(facts, shards, tie=["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
