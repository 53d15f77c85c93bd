"""Cone searches, candidate filters and lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.sky import distance_pc, in_cone, radius_to_deg, separation_deg, to_icrs
from starloom.functions.stellar import bp_rp, strict_motion
from starloom.operators.crossmatch import sky_join
from starloom.operators.profiles import profile

def dedupe_measurements(df: DataFrame, *order_by, within=()) -> DataFrame:
    """One row per measurement (position to 8 places, parallax and magnitudes to 6, catalog), the first in order; ``within`` are further key columns."""
    key = [*within] + [F.round(F.coalesce(c, F.lit(0.0)), 8) for c in ("ra", "dec")] + [F.round(c, 6) for c in ("parallax", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag")] + ["catalog_source"]
    first = Window.partitionBy(*key).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

def cone_search(stars: DataFrame, ra: float, dec: float, radius: float, limit: int = 100, unit: str = "deg", frame: str = "icrs") -> DataFrame:
    """Nearest stars in a cone, measured twice counting once, with distance_deg."""
    ra0, dec0 = to_icrs(F.lit(float(ra)), F.lit(float(dec)), frame)
    r = radius_to_deg(radius, unit)
    near = stars.where(in_cone("ra", "dec", ra0, dec0, r)).withColumn("distance_deg", separation_deg("ra", "dec", ra0, dec0))
    return dedupe_measurements(near, "distance_deg", "source_id").orderBy("distance_deg", "source_id").limit(limit)

def radial_search(stars: DataFrame, ra: float, dec: float, radius: float, mag_limit: float | None = None, min_parallax: float | None = None, limit: int = 100) -> DataFrame:
    if mag_limit is not None:
        stars = stars.where(F.col("phot_g_mean_mag") <= mag_limit)
    if min_parallax is not None:
        stars = stars.where(F.col("parallax") >= min_parallax)
    return cone_search(stars, ra, dec, radius, limit)

def score_cone(stars: DataFrame, mode: str = "balanced") -> DataFrame:
    """Add discovery_score and discovery_reasons (codes): transient, high RUWE, extreme colour."""
    p = profile(mode)
    colour = bp_rp()
    rules = [("transient", F.col("is_transient") == 1, 15.0), ("ruwe_elevated", F.col("ruwe") >= 1.4, p["ruwe_elevated"]), ("color_extreme", (colour <= -0.1) | (colour >= 2.8), p["color_extreme"])]
    score = sum((F.when(rule, w).otherwise(0.0) for _, rule, w in rules), F.lit(0.0))
    return stars.withColumn("discovery_score", score).withColumn("discovery_reasons", F.array_compact(F.array(*(F.when(rule, name) for name, rule, _ in rules))))

def lookup(stars: DataFrame, source_id: str) -> DataFrame:
    return stars.where(F.col("source_id") == source_id)

def nearby(stars: DataFrame, source_id: str, radius: float = 0.1, limit: int = 50) -> DataFrame:
    """Stars around a star, itself apart; none for an unknown one."""
    centre = lookup(stars, source_id).select("source_id", "ra", "dec")
    pairs = sky_join(centre, stars, radius).where("source_id <> source_id_b")
    return pairs.select(*(F.col(f"{c}_b").alias(c) for c in stars.columns), F.col("sep_deg").alias("distance_deg")).orderBy("distance_deg", "source_id").limit(limit)

def volume_filter(stars: DataFrame, limit: int | None = 8000, min_parallax: float | None = None, mag_limit: float | None = None) -> DataFrame:
    """Stars with parallax, the ``limit`` brightest (all, in no order, without a limit)."""
    df = stars.where("parallax > 0")
    if min_parallax is not None:
        df = df.where(F.col("parallax") >= min_parallax)
    if mag_limit is not None:
        df = df.where(F.col("phot_g_mean_mag") <= mag_limit)
    return df if limit is None else df.orderBy(F.coalesce("phot_g_mean_mag", F.lit(99.0)), F.desc("parallax"), "source_id").limit(limit)

def high_velocity(stars: DataFrame, min_snr: float = 5.0, min_pm: float = 100.0, limit: int | None = 100) -> DataFrame:
    pm = strict_motion()
    snr = F.try_divide(F.col("parallax"), F.col("parallax_error"))
    df = stars.withColumn("pm_total", pm).where((F.col("pm_total") > min_pm) & (F.col("parallax").isNull() | (snr > min_snr)) & (F.col("phot_g_mean_mag") < 16))
    df = df.orderBy(F.desc("pm_total"), "source_id") if limit is not None else df
    return df.limit(limit) if limit is not None else df

def binary_candidates(stars: DataFrame, min_ruwe: float = 1.4, min_parallax: float = 5.0, limit: int = 100) -> DataFrame:
    return stars.where((F.col("ruwe") > min_ruwe) & (F.col("parallax") > min_parallax)).orderBy(F.desc("ruwe"), "source_id").limit(limit)

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge)\b|;|--", re.I)

def custom_where(stars: DataFrame, condition: str, limit: int = 100) -> DataFrame:
    """Rows that meet a SQL condition; words that would change data are refused."""
    if _FORBIDDEN.search(condition):
        raise ValueError("the condition holds a forbidden word")
    return stars.where(F.expr(condition)).orderBy("source_id").limit(limit)

def candidate_filter(stars: DataFrame, min_ruwe=None, max_bp_rp=None, min_bp_rp=None, min_pm=None, min_distance=None, max_distance=None, min_g=None, max_g=None) -> DataFrame:
    """Bounds on derived quantities; a null fails every bound that is given."""
    d, colour, pm = distance_pc("parallax"), bp_rp(), strict_motion()
    tests: list[tuple] = [(min_ruwe, F.col("ruwe").__ge__), (max_bp_rp, colour.__lt__), (min_bp_rp, colour.__gt__), (min_pm, pm.__ge__), (min_distance, d.__ge__), (max_distance, d.__le__), (min_g, F.col("phot_g_mean_mag").__ge__), (max_g, F.col("phot_g_mean_mag").__le__)]
    for bound, test in tests:
        if bound is not None:
            stars = stars.where(test(bound))
    return stars

def hr_quality_cut(stars: DataFrame, min_snr: float = 5.0) -> DataFrame:
    snr = F.try_divide(F.col("parallax"), F.col("parallax_error"))
    return stars.where(F.coalesce(F.when(F.col("parallax_error") > 0, snr >= min_snr).otherwise(F.col("parallax") > 0), F.lit(False)))

def filter_otype(df: DataFrame, include=(), exclude=()) -> DataFrame:
    df = df.where(F.col("otype").isin(list(include))) if include else df
    return df.where(~F.coalesce(F.col("otype").isin(list(exclude)), F.lit(False))) if exclude else df

def out_of_coverage(requests: DataFrame, coverage: DataFrame, buffer: float = 2.0) -> DataFrame:
    """Add out: the request's position lies outside the covered box by more than the buffer."""
    box = F.broadcast(coverage)  # one row
    outside = (F.col("ra") < F.col("min_ra") - buffer) | (F.col("ra") > F.col("max_ra") + buffer) | (F.col("dec") < F.col("min_dec") - buffer) | (F.col("dec") > F.col("max_dec") + buffer)
    return requests.join(box.select("min_ra", "max_ra", "min_dec", "max_dec")).withColumn("out", outside).drop("min_ra", "max_ra", "min_dec", "max_dec")
