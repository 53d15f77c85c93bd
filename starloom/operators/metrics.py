"""Retrieval metrics over ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """Precision, recall, F1 and nDCG at each k and MRR by query, to four places.

    ``ranked`` is (query, rank, item), ``relevant`` (query, item). Precision divides by the results there
    are up to k; without relevant items recall is 0.
    """
    rel = relevant.select("query", "item").distinct()
    n_rel = rel.groupBy("query").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(rel.withColumn("_hit", F.lit(1)), ["query", "item"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0)))
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    parts = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        top = F.col("rank") <= k
        parts += [F.count_if(top).alias(f"n_{k}"), F.sum(F.when(top, F.col("hit")).otherwise(0)).alias(f"h_{k}"), F.sum(F.when(top & (F.col("hit") == 1), gain).otherwise(0.0)).alias(f"dcg_{k}")]
    g = hits.groupBy("query").agg(*parts).join(n_rel, "query", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out: list[Column] = [F.col("query"), F.round(zero(F.try_divide(F.lit(1.0), "first")), 4).alias("mrr")]
    for k in ks:
        p, r = zero(F.try_divide(f"h_{k}", f"n_{k}")), zero(F.try_divide(f"h_{k}", "n_rel"))
        n = F.least("n_rel", F.lit(k)).cast("int")
        ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)))
        out += [F.round(p, 4).alias(f"precision_{k}"), F.round(r, 4).alias(f"recall_{k}"), F.round(zero(F.try_divide(2 * p * r, p + r)), 4).alias(f"f1_{k}"), F.round(zero(F.try_divide(F.col(f"dcg_{k}"), ideal)), 4).alias(f"ndcg_{k}")]
    return g.select(*out)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*(F.round(F.avg(c), 4).alias(c) for c in per_query.columns if c != "query"))


def relative_improvement(value, base) -> Column:
    """Percent over a base; null where the base is 0."""
    return F.try_divide(F.col(value) - F.col(base), F.col(base)) * 100


def min_count_score(found, expected) -> Column:
    """Struct of score and status: PASS from the expected count on."""
    s = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(found), F.col(expected)), F.lit(1.0)))
    return F.struct(s.alias("score"), F.when(s >= 1, "PASS").otherwise("FAIL").alias("status"))


def discovery_score(found, expected) -> Column:
    """PASS, PARTIAL or FAIL: 1, 0.5 or 0."""
    done, some = F.col(found) >= F.col(expected), F.col(found) > 0
    return F.struct(F.when(done, 1.0).when(some, 0.5).otherwise(0.0).alias("score"), F.when(done, "PASS").when(some, "PARTIAL").otherwise("FAIL").alias("status"))


def hybrid_score(stars, papers, expected) -> Column:
    """Half for stars, half for papers, all of it once the expected count is met."""
    n = F.col(stars) + F.col(papers)
    s = F.when(n >= F.col(expected), 1.0).otherwise(F.when(F.col(stars) > 0, 0.5).otherwise(0.0) + F.when(F.col(papers) > 0, 0.5).otherwise(0.0))
    return F.struct(s.alias("score"), F.when(s >= 0.8, "PASS").otherwise("FAIL").alias("status"))
