"""Discovery ranking: anomaly score, neighbourhood context, confidence, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import finite, normalize_object_class
from starloom.functions.stellar import bp_rp, confidence, total_motion
from starloom.plans.durable import durable
from starloom.operators.crossmatch import neighbour_context
from starloom.operators.profiles import perturbed, profile

_NUMBERS = ("ra", "dec", "parallax", "pmra", "pmdec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "ruwe")


def _is_gaia() -> Column:
    return F.upper(F.trim(F.coalesce("catalog_source", F.lit("GAIA")))).isin("GAIA", "")


def pool(stars: DataFrame, pool_limit: int = 3000) -> DataFrame:
    """The brightest ``pool_limit`` GAIA rows, and every other row."""
    gaia = stars.where(_is_gaia()).orderBy(F.coalesce("phot_g_mean_mag", F.lit(99.0)), F.desc(F.coalesce("parallax", F.lit(-1.0))), "source_id").limit(pool_limit)
    return gaia.union(stars.where(~_is_gaia()))


def score_rules(weight) -> list[tuple[str, Column, Column]]:
    """(reason code, condition, points) in the order in which reasons are listed; ``weight`` gives a Column by name."""
    colour, motion, other = F.col("bp_rp"), F.col("pm_total"), F.col("catalog") != "GAIA"
    ruwe, g, d = F.col("ruwe"), F.col("phot_g_mean_mag"), F.col("distance_pc")
    return [
        ("catalog_object", other, weight("catalog_bonus")),
        ("ruwe_very_high", ruwe >= 2.0, weight("ruwe_high")),
        ("ruwe_elevated", (ruwe >= 1.4) & (ruwe < 2.0), weight("ruwe_elevated")),
        ("ruwe_tight", ruwe < 0.9, weight("ruwe_tight")),
        ("ruwe_missing", ruwe.isNull(), weight("ruwe_missing")),
        ("very_blue", colour <= -0.1, weight("color_extreme")),
        ("very_red", colour >= 2.8, weight("color_extreme")),
        ("no_color_profile", colour.isNull() & other, weight("no_color_profile")),
        ("fast_motion", motion >= 80, weight("motion_high")),
        ("notable_motion", (motion >= 40) & (motion < 80), weight("motion_mid")),
        ("bright_distant", (g <= 10) & (d >= 500), weight("brightness_anomaly")),
        ("faint_nearby", (g >= 16) & (d <= 50), weight("brightness_anomaly")),
    ]


def features(stars: DataFrame) -> DataFrame:
    """Clean numbers and derived catalog, distance_pc, bp_rp and pm_total; rows without a position go."""
    clean = stars.select(*(finite(c).alias(c) if c in _NUMBERS else F.col(c) for c in stars.columns))
    return (
        clean.where("ra IS NOT NULL AND dec IS NOT NULL")
        .withColumn("catalog", F.upper(F.when(F.trim("catalog_source") != "", F.trim("catalog_source")).otherwise("GAIA")))
        .withColumn("distance_pc", F.when(F.col("parallax") > 0, 1000.0 / F.col("parallax")))
        .withColumn("bp_rp", bp_rp())
        .withColumn("pm_total", total_motion())
        .withColumn("object_class", normalize_object_class("object_class"))
    )


def base_score(stars: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add base_score and reasons (codes) to features."""
    rules = score_rules(lambda name: F.lit(weights[name]))
    score = sum((F.when(rule, w).otherwise(0.0) for _, rule, w in rules), F.lit(0.0))
    return features(stars).withColumn("base_score", score).withColumn("reasons", F.array_compact(F.array(*(F.when(rule, code) for code, rule, _ in rules))))


def _context_points(weight) -> Column:
    n, density = F.size("matched_catalogs"), F.col("local_density")
    crowd = F.when(density > 1, F.least((density - 1) * weight("density_scale"), weight("density_cap"))).otherwise(0.0)
    cross = F.when(n > 0, F.least(weight("cross_match_base") + n * weight("cross_match_per_catalog"), weight("cross_match_cap"))).otherwise(0.0)
    overlap = F.when(F.col("catalog") != "GAIA", F.least(n * weight("catalog_overlap_bonus"), weight("catalog_overlap_cap"))).otherwise(0.0)
    return crowd + cross + overlap


def context_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add score and the reasons of crowding and cross-matches to rows with neighbour context."""
    points = _context_points(lambda name: F.lit(weights[name]))
    more = F.array_compact(F.array(F.when(F.col("local_density") > 1, "crowded_field"), F.when(F.size("matched_catalogs") > 0, "cross_matched")))
    return df.withColumn("score", F.round(F.least(F.col("base_score") + points, F.lit(100.0)), 1)).withColumn("reasons", F.concat("reasons", more))


def workset(scored: DataFrame, limit: int) -> DataFrame:
    """The best max(4 limit, 24) rows, and every row of another catalog than GAIA."""
    best = scored.orderBy(F.desc("base_score"), F.desc(F.col("phot_g_mean_mag").isNotNull()), F.coalesce("phot_g_mean_mag", F.lit(99.0)), "source_id").limit(max(4 * limit, 24))
    return best.where("catalog = 'GAIA'").union(scored.where("catalog <> 'GAIA'"))


def scored_pool(stars: DataFrame, limit: int, pool_limit: int, radius_deg: float, weights: dict[str, float]) -> DataFrame:
    """The work-set with its context and final score; neighbours come from the whole pool."""
    pooled = pool(stars, pool_limit)
    return context_score(neighbour_context(workset(base_score(pooled, weights), limit), pooled, radius_deg), weights)


_ORDER = (F.desc, "score"), (F.desc, "has_distance"), (F.asc, "g_order"), (F.asc, "source_id")


def rank_discovery_candidates(stars: DataFrame, limit: int = 15, pool_limit: int = 3000, radius_deg: float = 0.08, mode: str = "balanced", weights: dict[str, float] | None = None) -> DataFrame:
    """The ``limit`` best candidates with score, confidence, score_uncertainty and up to four reasons."""
    scored = scored_pool(stars, limit, pool_limit, radius_deg, weights or profile(mode))
    ordered = scored.withColumn("has_distance", F.col("distance_pc").isNotNull()).withColumn("g_order", F.coalesce("phot_g_mean_mag", F.lit(99.0))).orderBy(*(f(c) for f, c in _ORDER)).limit(limit)
    c = confidence("score")
    return ordered.withColumn("_c", c).select(
        "source_id", F.col("catalog").alias("catalog_source"), "ra", "dec", "parallax", "distance_pc", "phot_g_mean_mag", "ruwe", "object_class", "bp_rp", "local_density", "matched_catalogs", "score",
        F.col("_c.confidence").alias("confidence"), F.col("_c.score_uncertainty").alias("score_uncertainty"), F.slice("reasons", 1, 4).alias("reasons"),
    )


def overlap_totals(scored: DataFrame) -> DataFrame:
    """Candidates with a match in another catalog, and their share of the work-set."""
    n = F.count_if(F.size("matched_catalogs") > 0)
    return scored.agg(n.alias("candidates_with_overlap"), F.round(F.coalesce(F.try_divide(n, F.count("*")), F.lit(0.0)), 3).alias("candidate_ratio"))


def robust_sweep(stars: DataFrame, mode: str = "balanced", seeds=(42, 43, 44, 45, 46), radius_deg: float = 0.08) -> DataFrame:
    """Mean and spread of every star's score under perturbed weights: mean_score, std_dev, confidence.

    Features and context are computed once; the seeds are a handful of constant columns, not a join.
    """
    pooled = features(stars)
    table = neighbour_context(pooled, pooled, radius_deg)
    scores = []
    for seed in seeds:
        w = perturbed(profile(mode), seed)
        rules = score_rules(lambda name, w=w: F.lit(w[name]))
        base = sum((F.when(rule, points).otherwise(0.0) for _, rule, points in rules), F.lit(0.0))
        scores.append(F.round(F.least(base + _context_points(lambda name, w=w: F.lit(w[name])), F.lit(100.0)), 1))
    n = len(scores)
    # Term by term: what a lambda function mentions is computed anew for every element.
    out = table.select("source_id", *(x.alias(f"_{i}") for i, x in enumerate(scores)))
    out = out.withColumn("_mean", sum((F.col(f"_{i}") for i in range(n)), F.lit(0.0)) / n)
    out = out.withColumn("_std", F.sqrt(sum((F.pow(F.col(f"_{i}") - F.col("_mean"), 2) for i in range(n)), F.lit(0.0)) / n))
    label = F.when(F.col("_std") < 1, "High").when(F.col("_std") < 3, "Medium").otherwise("Low")
    return out.select("source_id", F.round("_mean", 2).alias("mean_score"), F.round("_std", 3).alias("std_dev"), label.alias("confidence"))


def robust_candidates(stars: DataFrame, ra: float, dec: float, radius: float, mode: str = "balanced", limit: int = 100, seeds=(42, 43, 44, 45, 46)) -> DataFrame:
    """The nearest ``limit`` stars of a cone with the mean and spread of their scores among themselves, best mean first.

    A star that the sweep leaves out keeps its row, without scores, and counts as 0 in the order; ties go by source_id.
    """
    from starloom.operators.cone import cone_search

    found = durable(cone_search(stars, ra, dec, radius, limit=limit), "cone")
    scores = robust_sweep(found, mode, seeds).groupBy("source_id").agg(F.max(F.struct("mean_score", "std_dev", "confidence")).alias("robust_score"))
    return found.join(scores, "source_id", "left").orderBy(F.desc(F.coalesce("robust_score.mean_score", F.lit(0.0))), "source_id")


def feature_importance(stars: DataFrame, mode: str = "balanced") -> DataFrame:
    """Shares of RUWE, colour and motion in each star's points."""
    w = profile(mode)
    rules = {code: (rule, points) for code, rule, points in score_rules(lambda n: F.lit(w[n]))}
    part = lambda *codes: sum((F.when(rules[c][0], rules[c][1]).otherwise(0.0) for c in codes), F.lit(0.0))
    df = features(stars).withColumn("_r", part("ruwe_very_high", "ruwe_elevated")).withColumn("_c", part("very_blue", "very_red")).withColumn("_m", part("fast_motion", "notable_motion"))
    total = F.col("_r") + F.col("_c") + F.col("_m")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)), 2)
    return df.select("source_id", share("_r").alias("ruwe"), share("_c").alias("color"), share("_m").alias("motion"))


def score_distribution(scored: DataFrame, score: str = "score") -> DataFrame:
    x = F.col(score)
    return scored.agg(F.count("*").alias("n"), F.count_if(x > 0).alias("non_zero"), F.max(x).alias("max_score"), F.avg(x).alias("mean_score"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("rate"))


