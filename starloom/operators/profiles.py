"""Scoring profiles of discovery ranking."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Weights by mode.
WEIGHTS = {
    "strict": {
        "catalog_bonus": 6.0,
        "ruwe_missing": 1.0,
        "ruwe_high": 14.0,
        "ruwe_elevated": 8.0,
        "ruwe_tight": 1.5,
        "color_extreme": 10.0,
        "no_color_profile": 2.5,
        "motion_high": 16.0,
        "motion_mid": 8.0,
        "brightness_anomaly": 5.0,
        "density_scale": 0.15,
        "density_cap": 1.2,
        "cross_match_base": 2.0,
        "cross_match_per_catalog": 0.6,
        "cross_match_cap": 3.0,
        "catalog_overlap_bonus": 0.4,
        "catalog_overlap_cap": 1.5,
    },
    "balanced": {
        "catalog_bonus": 8.0,
        "ruwe_missing": 1.5,
        "ruwe_high": 16.0,
        "ruwe_elevated": 9.0,
        "ruwe_tight": 2.0,
        "color_extreme": 10.5,
        "no_color_profile": 3.5,
        "motion_high": 14.0,
        "motion_mid": 7.0,
        "brightness_anomaly": 5.5,
        "density_scale": 0.2,
        "density_cap": 1.8,
        "cross_match_base": 2.5,
        "cross_match_per_catalog": 0.8,
        "cross_match_cap": 4.0,
        "catalog_overlap_bonus": 0.5,
        "catalog_overlap_cap": 1.8,
    },
    "aggressive": {
        "catalog_bonus": 11.0,
        "ruwe_missing": 2.0,
        "ruwe_high": 18.0,
        "ruwe_elevated": 11.0,
        "ruwe_tight": 2.5,
        "color_extreme": 11.5,
        "no_color_profile": 4.5,
        "motion_high": 14.0,
        "motion_mid": 7.0,
        "brightness_anomaly": 6.5,
        "density_scale": 0.28,
        "density_cap": 2.8,
        "cross_match_base": 3.5,
        "cross_match_per_catalog": 1.0,
        "cross_match_cap": 5.5,
        "catalog_overlap_bonus": 0.8,
        "catalog_overlap_cap": 2.8,
    },
}
# The search service weighs motion less in two modes.
SERVICE_MOTION = {"strict": (14.0, 7.0), "balanced": (12.0, 6.0)}


def profile(mode: str | None = "balanced", variant: str = "ranker") -> dict[str, float]:
    """Weights by name; an unknown mode is balanced. Variant ``service`` has the search service's motion weights."""
    name = (mode or "balanced").strip().lower()
    name = name if name in WEIGHTS else "balanced"
    weights = dict(WEIGHTS[name])
    if variant == "service" and name in SERVICE_MOTION:
        weights["motion_high"], weights["motion_mid"] = SERVICE_MOTION[name]
    return weights


def profiles(spark: SparkSession, variant: str = "ranker") -> DataFrame:
    return spark.createDataFrame([(variant, m, w, v) for m in WEIGHTS for w, v in profile(m, variant).items()], "variant string, mode string, weight string, value double")


def perturbed(weights: dict[str, float], seed: int, spread: float = 0.05) -> dict[str, float]:
    """Each weight with a gaussian relative error, drawn in the weights' order."""
    draw = random.Random(seed)
    return {k: v * (1.0 + draw.gauss(0, spread)) for k, v in weights.items()}
