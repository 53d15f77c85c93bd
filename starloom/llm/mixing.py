"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.names import unused
from starloom.plans.durable import durable

#: Most quantile entries (8 bytes each, all sources together) that are broadcast; beyond it the join is salted.
BROADCAST_ENTRIES = 500_000
SALTS = 64


def unit_hash(*cols):
    """A double in (0, 1) from the first 52 bits of an md5; the same in every engine."""
    text = F.concat_ws("/", *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, targets: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): the mean number of copies that brings each source to its weight.

    A source's size is the UTF-8 bytes of its texts plus one a document. ``targets`` (source, weight)
    names relative weights, and sources that it leaves out get none; without it the weight is
    ``size ** exponent``, which flattens the mixture. The mixture as a whole is ``epochs`` times the input.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(exponent)))
    else:
        t = targets.groupBy(F.col("source").alias("t_source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    everything = Window.partitionBy()  # one row per source
    total, weights = F.sum("size").over(everything), F.sum("weight").over(everything)
    return weighted.select("source", "size", F.coalesce(F.try_divide(F.col("weight") * total * F.lit(float(epochs)), weights * F.col("size")), F.lit(0.0)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Per source, P(count <= k) for k = 0, 1, ... as far as a 52-bit uniform number can tell.

    Logarithms keep large rates from underflowing; the running sum of ln k is the log factorial.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("long")
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    return (
        rates.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("log_factorial", F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(up_to))
        .withColumn("cdf", F.sum(p).over(up_to))
        .groupBy("source", "rate")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf"))
    )


def mix(docs: DataFrame, targets: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """Replicate each document by a Poisson count with its source's mean, and shuffle all copies.

    The count inverts the Poisson distribution at a uniform hash of (seed, doc_id), so it needs no
    state, no order and no second look at the data, and repeats exactly when a task is run again.
    Returns the input's columns plus rate, copy_no (from 1) and shuffle_key; rows are dealt and sorted by
    shuffle_key, a hash of (seed, doc_id, copy_no), which is a uniform global order.

    Edge cases: a null source is a source of its own; a null text has size 0 plus 1; rows with equal
    doc_id share a draw; a very long text counts by its bytes like any other; an empty table gives no row; input columns named rate, copy_no or shuffle_key
    are replaced.
    """
    docs = docs.drop("rate", "copy_no", "shuffle_key")
    source, cdf, salt, salt2, n = unused([*docs.columns, "rate", "copy_no", "shuffle_key"], "_source", "_cdf", "_salt", "_salt2", "_n")
    tables = durable(poisson_tables(source_rates(docs, targets, exponent, epochs)), "mixing").select(F.col("source").alias(source), "rate", F.col("cdf").alias(cdf))
    entries = tables.agg(F.sum(F.size(cdf))).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col(source))
    if entries <= BROADCAST_ENTRIES:
        joined = docs.join(F.broadcast(tables), same)
    else:  # salted: no task gets all rows of a source
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        copies = tables.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col(salt) == F.col(salt2))).drop(salt, salt2)
    u = unit_hash(F.lit(seed), F.col("doc_id"))
    counted = joined.withColumn(n, F.size(F.filter(cdf, lambda c: c < u))).drop(cdf, source)
    copies = counted.where(F.col(n) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    key = F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy_no"))
    return copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy_no")


def replicate(docs: DataFrame, **options) -> DataFrame:
    """The copies of ``mix`` with the columns that the documents came with; columns named like those that it adds keep their values."""
    added = ["rate", "copy_no", "shuffle_key"]
    aside = {c: unused([*docs.columns, *added], c)[0] for c in docs.columns if c.lower() in added}
    mixed = mix(docs.withColumnsRenamed(aside), **options)
    return mixed.drop(*added).withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)


ORACLE = """
WITH sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM sizes),
rates AS (SELECT source, weight * (SELECT sum(size) FROM weighted) / ((SELECT sum(weight) FROM weighted) * size) AS rate FROM weighted),
steps AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
facts AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lf FROM steps),
cdfs AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM facts),
draws AS (SELECT *, (CAST(('0x' || substr(md5('42/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
lists AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM cdfs GROUP BY source),
counts AS (SELECT d.*, len(list_filter(l.cdf, lambda c: c < d.u)) AS n FROM draws d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM counts WHERE n > 0)
SELECT doc_id, source, lang, n_chars, text, CAST(copy_no AS INTEGER) AS copy_no,
 CAST(('0x' || substr(md5('42/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || CAST(copy_no AS VARCHAR)), 1, 15)) AS BIGINT) AS shuffle_key
FROM copies
"""
