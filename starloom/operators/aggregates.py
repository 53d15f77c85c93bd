"""Summaries of catalogs, regions, clusters, alerts and evaluations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import normalize_catalog, normalize_object_class
from starloom.functions.sky import from_cartesian, in_cone
from starloom.functions.stellar import absolute_mag, anomaly_types, bp_rp, hr_mass, log_g, population14, strict_motion, teff
from starloom.operators.crossmatch import counts_in_radii, region_members


def count_in_cone(stars: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    return stars.where(in_cone("ra", "dec", ra, dec, radius)).agg(F.count("*").alias("n"))


def catalog_summary(stars: DataFrame, upper: bool = False) -> DataFrame:
    name = F.coalesce(F.when(F.trim("catalog_source") != "", F.trim("catalog_source")), F.lit("UNKNOWN"))
    return stars.groupBy((F.upper(name) if upper else name).alias("catalog")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "catalog")


def coverage(stars: DataFrame) -> DataFrame:
    box = stars.agg(F.count("*").alias("n"), *(F.round(f(c), 2).alias(f"{k}_{c}") for c in ("ra", "dec") for k, f in (("min", F.min), ("max", F.max))))
    return box.withColumn("centre_ra", F.round((F.col("min_ra") + F.col("max_ra")) / 2, 2)).withColumn("centre_dec", F.round((F.col("min_dec") + F.col("max_dec")) / 2, 2))


def density(stars: DataFrame, ra: float, dec: float, radius: float, cap: int = 1000) -> DataFrame:
    """Stars per square degree; the count is capped like the interactive search that it mirrors (None: uncapped)."""
    n = F.col("n") if cap is None else F.least("n", F.lit(cap))
    return count_in_cone(stars, ra, dec, radius).select("n", (n / (math.pi * radius**2)).alias("density"))


def density_anomaly(stars: DataFrame, r_small: float = 0.1, r_large: float = 1.0) -> DataFrame:
    """Ratio of the surface densities within both radii around every star; a peak above 3. Crowded fields are counted by cells, not by pairs."""
    near = counts_in_radii(stars, [r_small, r_large]).withColumnsRenamed({"n0": "n_small", "n1": "n_large"})
    ratio = (F.col("n_small") / r_small**2) / (F.col("n_large") / r_large**2)
    return near.withColumn("ratio", ratio).withColumn("is_peak", ratio > 3)


def region_counts(stars: DataFrame, regions: DataFrame) -> DataFrame:
    n = region_members(stars, regions).groupBy("region").agg(F.count("*").alias("star_count"))
    return regions.join(n, regions["name"] == n["region"], "left").select(regions["name"].alias("region"), F.coalesce("star_count", F.lit(0).cast("long")).alias("star_count"))


def compare_regions(stars: DataFrame, regions: DataFrame, a: str, b: str) -> DataFrame:
    """Count, mean magnitude, colour, motion and surface density of two regions."""
    m = region_members(stars, regions.where(F.col("name").isin(a, b)))
    return m.groupBy("region").agg(F.count("*").alias("n"), F.avg("phot_g_mean_mag").alias("mean_g"), F.avg(bp_rp()).alias("mean_bp_rp"), F.avg(strict_motion()).alias("mean_pm"), (F.count("*") / (math.pi * F.pow(F.max("radius_deg"), 2))).alias("density"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")).union(edges.groupBy(F.col("rel").alias("what")).agg(F.count("*").alias("n")))


def hr_points(stars: DataFrame) -> DataFrame:
    """Colour, absolute magnitude and population of stars on the Hertzsprung-Russell diagram."""
    return stars.withColumn("color", bp_rp()).withColumn("abs_mag", absolute_mag()).where("color IS NOT NULL AND abs_mag IS NOT NULL").withColumn("population", population14(F.col("color"), F.col("abs_mag")))


def hr_statistics(points: DataFrame) -> DataFrame:
    return points.groupBy("population").agg(F.count("*").alias("n"), F.min("color").alias("min_color"), F.max("color").alias("max_color"), F.min("abs_mag").alias("min_mag"), F.max("abs_mag").alias("max_mag"))


def hr_grid(points: DataFrame, width: int = 80, height: int = 40, score: str | None = None) -> DataFrame:
    """Counts on a grid over the points' own range; with the largest score of a cell if there is one."""
    box = points.agg(F.min("color").alias("c0"), F.max("color").alias("c1"), F.min("abs_mag").alias("m0"), F.max("abs_mag").alias("m1"))
    at = lambda x, lo, hi, n: F.least(F.floor(F.coalesce(F.try_divide(F.col(x) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    cells = points.join(F.broadcast(box)).groupBy(at("color", "c0", "c1", width).alias("column"), at("abs_mag", "m0", "m1", height).alias("row"))
    return cells.agg(F.count("*").alias("n"), *([F.max(score).alias("max_score")] if score else []))


def otype_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.when(F.trim("otype") != "", F.col("otype")), F.lit("Unknown")).alias("otype")).agg(F.count("*").alias("n"))


def catalog_comparison(registered: DataFrame) -> DataFrame:
    """Totals and matches by catalog of cross-registered stars."""
    return registered.groupBy(normalize_catalog("catalog_source").alias("catalog")).agg(F.count("*").alias("total"), F.count_if("validated").alias("matched"))


def bounds(points: DataFrame, columns=("x_pc", "y_pc", "z_pc")) -> DataFrame:
    return points.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))))


def cluster_summary(assigned: DataFrame, x=("x_pc", "y_pc", "z_pc"), display=("display_x_pc", "display_y_pc", "display_z_pc")) -> DataFrame:
    """Per cluster: count, centroids, mean direction, spread, fog radius, zoom, and its three commonest catalogs and classes."""
    a, d = F.radians("ra"), F.radians("dec")
    unit = {"ux": F.cos(d) * F.cos(a), "uy": F.sin(d), "uz": F.cos(d) * F.sin(a)}
    means = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in (*x, *display)), *(F.avg(v).alias(k) for k, v in unit.items()))
    ra, dec, _ = from_cartesian("ux", "uy", "uz")
    centred = assigned.select("cluster", *display).join(means.select("cluster", *(F.col(c).alias(f"m_{c}") for c in display)), "cluster")
    spread = centred.groupBy("cluster").agg(F.avg(F.sqrt(sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in display), F.lit(0.0)))).alias("spread"))

    def top3(label, name: str) -> DataFrame:
        counts = assigned.groupBy("cluster", label.alias("label")).agg(F.count("*").alias("k"))
        order = Window.partitionBy("cluster").orderBy(F.desc("k"), "label")
        return counts.withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]).alias(name))

    out = means.withColumn("ra", ra).withColumn("dec", dec).drop("ux", "uy", "uz").join(spread, "cluster")
    out = out.withColumn("fog_radius", F.greatest(F.col("spread") * 1.65, F.lit(6.0))).withColumn("suggested_zoom", F.greatest(F.lit(1.6), F.least(F.lit(18.0), 10.5 / F.greatest("spread", F.lit(0.8)))))
    return out.join(top3(normalize_catalog("catalog_source", "UNKNOWN"), "dominant_catalogs"), "cluster").join(top3(F.coalesce(normalize_object_class("object_class"), F.lit("UNCLASSIFIED")), "dominant_classes"), "cluster")


def cluster_physics(members: DataFrame, group: str = "region") -> DataFrame:
    """Median colour and absolute magnitude of a group (0.5 and 4.7 where unknown), and the physics that they imply."""
    m = members.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.median(bp_rp()), F.lit(0.5)).alias("median_color"), F.coalesce(F.median(absolute_mag()), F.lit(4.7)).alias("median_mag"))
    return m.withColumn("mass", hr_mass(F.col("median_color"), F.col("median_mag"))).withColumn("teff_k", teff(F.col("median_color"))).withColumn("log_g", log_g(F.col("mass")))


def batch_summary(scored: DataFrame, score: str = "score") -> DataFrame:
    fast = (F.col("ruwe") > 1.4) | (strict_motion() > 100)
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col(score) > 10).alias("high_score"), F.count_if(F.coalesce(fast, F.lit(False))).alias("anomalous"), F.avg("phot_g_mean_mag").alias("mean_g"), F.min("phot_g_mean_mag").alias("min_g"), F.max("phot_g_mean_mag").alias("max_g"))


def literature_digest(papers: DataFrame, n: int = 5) -> DataFrame:
    return papers.orderBy(F.desc("published_date"), "arxiv_id").limit(n).select("arxiv_id", "title", F.left("abstract", F.lit(200)).alias("preview"))


def type_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def confusion(scored: DataFrame, truth: str = "anomaly", score: str = "score", threshold: float = 8.0) -> DataFrame:
    """Confusion matrix with precision, recall and F1 at a score threshold."""
    p, t = F.col(score) >= threshold, F.col(truth)
    counts = scored.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = counts.withColumn("precision", zero(F.try_divide("tp", F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide("tp", F.col("tp") + F.col("fn"))))
    return counts.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def expert_recall(scored: DataFrame, catalog: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Share of an expert's stars (source_id) that score at least ``threshold``."""
    known = scored.join(catalog.select("source_id").distinct(), "source_id", "left_semi")
    return known.agg(F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("found")).withColumn("recall", F.coalesce(F.try_divide("found", "n"), F.lit(0.0)))


def calibration_status(matrix: DataFrame, target: float = 0.9) -> DataFrame:
    return matrix.withColumn("status", F.when(F.col("precision") >= target, "calibrated").otherwise("needs_calibration"))


def anomaly_totals(scored: DataFrame, top_k: int = 20) -> DataFrame:
    """How often each anomaly type occurs among the ``top_k`` of each region."""
    order = Window.partitionBy("region").orderBy(F.desc("score"), "source_id")
    top = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
    return top.select(F.explode(anomaly_types()).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def discovery_precision(scored: DataFrame, top_k: int = 20) -> DataFrame:
    """Per region, and over all of them (region null): stars, those with a score above 0, candidates looked at, confirmed ones, and the precision.

    A candidate is one of a region's ``top_k`` by score; it is confirmed by any anomaly type. A region's precision is over its
    candidates; the overall one is over the lesser of ``top_k`` and the scored stars of each region, to three places.
    """
    order = Window.partitionBy("region").orderBy(F.desc("score"), "source_id")
    ranked = scored.withColumn("_top", F.row_number().over(order) <= top_k).withColumn("_hit", F.size(anomaly_types()) > 0)
    by = ranked.groupBy("region").agg(F.count("*").alias("total_stars"), F.count_if(F.coalesce(F.col("score") > 0, F.lit(False))).alias("total_scored"), F.count_if("_top").alias("candidates"), F.count_if(F.col("_top") & F.col("_hit")).alias("confirmed"))
    over = by.agg(F.lit(None).cast("string").alias("region"), *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total_stars", "total_scored")), F.coalesce(F.sum(F.least("total_scored", F.lit(top_k))), F.lit(0).cast("long")).alias("candidates"), F.coalesce(F.sum("confirmed"), F.lit(0).cast("long")).alias("confirmed"))
    return by.unionByName(over).withColumn("precision", F.round(F.coalesce(F.try_divide("confirmed", "candidates"), F.lit(0.0)), 3))


def ingest_stats(stars: DataFrame) -> DataFrame:
    """One row: all stars, distinct catalogs, and the count of each."""
    by = catalog_summary(stars)
    return by.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"), F.count("*").alias("catalogs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("catalog", "n")))).alias("by_catalog"))


def regions_by_type(regions: DataFrame, kind: str = "type") -> DataFrame:
    """(type, regions, stars, names): regions and their stored counts by type; a missing type is UNKNOWN."""
    name = F.coalesce(F.when(F.trim(kind) != "", F.trim(kind)), F.lit("UNKNOWN")).alias("type")
    return regions.groupBy(name).agg(F.count("*").alias("regions"), F.coalesce(F.sum("star_count"), F.lit(0).cast("long")).alias("stars"), F.array_sort(F.collect_set("name")).alias("names"))


def benchmark_stats(results: DataFrame) -> DataFrame:
    """Pass rate, mean score and latency by query type and difficulty (results: type, difficulty, status, score, latency_ms)."""
    return results.groupBy("type", "difficulty").agg(F.count("*").alias("n"), F.avg(F.when(F.col("status") == "PASS", 1.0).otherwise(0.0)).alias("pass_rate"), F.avg("score").alias("mean_score"), F.avg("latency_ms").alias("mean_latency_ms"))


def system_stats(**tables: DataFrame) -> DataFrame:
    """Exact row counts of several tables, one row each."""
    counts = [t.agg(F.count("*").alias("n")).withColumn("what", F.lit(k)) for k, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.select("what", "n")
