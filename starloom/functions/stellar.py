"""Stellar physics and measurement confidence as Column expressions. Magnitude 0.0 is a magnitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.columns import col


def bands(value: Column, steps: list, last) -> Column:
    """``steps`` is [(upper bound, result)], exclusive, in order; null stays null."""
    out = None
    for bound, result in steps:
        out = F.when(value < bound, result) if out is None else out.when(value < bound, result)
    return out.when(value.isNotNull(), last)


def bp_rp(bp="phot_bp_mean_mag", rp="phot_rp_mean_mag") -> Column:
    return col(bp) - col(rp)


def total_motion(pmra="pmra", pmdec="pmdec") -> Column:
    """A missing component counts as 0; null if nothing moves."""
    m = F.sqrt(F.coalesce(F.pow(col(pmra), 2), F.lit(0.0)) + F.coalesce(F.pow(col(pmdec), 2), F.lit(0.0)))
    return F.when(m > 0, m)


def strict_motion(pmra="pmra", pmdec="pmdec") -> Column:
    return F.sqrt(F.pow(col(pmra), 2) + F.pow(col(pmdec), 2))


def absolute_mag(g="phot_g_mean_mag", parallax="parallax") -> Column:
    p = col(parallax)
    return F.when(p > 0, col(g) + 5 + 5 * F.log10(p / 1000.0))


def absolute_mag_error(g_error=0.01, parallax="parallax", parallax_error=0.01) -> Column:
    p = col(parallax)
    return F.when(p > 0, F.round(F.sqrt(F.pow(F.coalesce(col(g_error), F.lit(0.01)), 2) + F.pow(5.0 / math.log(10) * F.coalesce(col(parallax_error), F.lit(0.01)) / p, 2)), 3))


def teff_error(bp_error, rp_error) -> Column:
    return F.sqrt(F.pow(col(bp_error), 2) + F.pow(col(rp_error), 2)) * 1e4


def binary_separation(ruwe="ruwe", parallax="parallax") -> Column:
    r, p = col(ruwe), col(parallax)
    return F.when((r > 1) & (p > 0), (r - 1) * (1000.0 / p) * 0.5).otherwise(0.0)


def angular_size_pc(radius_deg, parallax="parallax") -> Column:
    p = col(parallax)
    return F.when(p > 0, F.radians(col(radius_deg)) * 1000.0 / p)


def population5(colour: Column, m_g: Column) -> Column:
    """Five coarse classes; the first that fits."""
    return (
        F.when((m_g < 3) & (colour < 0.8), "Main Sequence (O/B/A)")
        .when((m_g < 1) & (colour > 1.2), "Giant Branch")
        .when(m_g > 10, "White Dwarf Candidate")
        .when(colour > 2.5, "M-Dwarf / Low Mass")
        .when(m_g.isNotNull() & colour.isNotNull(), "Main Sequence")
    )


def population14(colour: Column, m_g: Column) -> Column:
    """Fourteen classes by colour band and absolute magnitude; Unknown where either is missing."""
    blue = bands(m_g, [(2, "Blue Supergiant"), (5, "Blue Straggler")], "Hot Subdwarf")
    white = bands(m_g, [(4, "Main Sequence (O-B)")], "White Dwarf Candidate")
    yellow = bands(m_g, [(4, "Giant/Subgiant"), (6, "Main Sequence (A-F)")], "Main Sequence (G)")
    orange = bands(m_g, [(5, "K Giant"), (9, "Main Sequence (K)")], "K Dwarf")
    red = bands(m_g, [(5, "M Giant"), (10, "M Dwarf")], "Brown Dwarf Candidate")
    return F.coalesce(bands(colour, [(-0.2, blue), (0.5, white), (1.6, yellow), (2.7, orange)], red), F.lit("Unknown"))


def teff(colour: Column) -> Column:
    c = colour
    return F.when(c <= -0.1, F.lit(20000.0)).otherwise(
        bands(
            c,
            [(0.2, 9200.0 - 7000.0 * (c + 0.1) / 0.3), (0.6, 7200.0 - 2000.0 * (c - 0.2) / 0.4), (1.2, 5800.0 - 1800.0 * (c - 0.6) / 0.6), (2.1, 4200.0 - 1600.0 * (c - 1.2) / 0.9)],
            F.lit(3000.0),
        )
    )


def hr_mass(colour: Column, m_g: Column) -> Column:
    log_m = bands(colour, [(-0.2, 0.25 * m_g - 1.5), (0.0, 0.17 * m_g - 0.9), (0.6, 0.27 * m_g - 1.3), (1.4, 0.25 * m_g - 1.0)], 0.2 * m_g - 0.5)
    m = F.pow(F.lit(10.0), log_m)
    return F.round(F.when(m < 0.08, 0.08).when(m > 20, 20.0).otherwise(m), 2)


def log_g(mass: Column) -> Column:
    return bands(mass, [(0.8, F.lit(4.6)), (1.2, F.lit(4.4)), (2.5, F.lit(4.3))], F.lit(4.0))


def metallicity(catalog="catalog_source") -> Column:
    name = F.upper(F.coalesce(col(catalog), F.lit("")))
    return F.when(name.contains("SMC"), 0.004).when(name.contains("LMC"), 0.008).otherwise(0.02)


def fallback_mass(teff_known: Column, colour: Column) -> Column:
    by_teff = bands(teff_known, [(5000, F.lit(0.75)), (6000, F.lit(0.95)), (7500, F.lit(1.15)), (9000, F.lit(1.7))], F.lit(2.2))
    by_colour = F.when(colour <= 0.0, 1.8).when(colour <= 0.6, 1.2).when(colour <= 1.4, 0.95).when(colour.isNotNull(), 0.75)
    return F.coalesce(by_teff, by_colour, F.lit(1.0))


def physical_parameters(teff_known: Column | None = None) -> Column:
    """Struct of mass, log g, temperature, metallicity, colour, M_G, ruwe, high_motion and the method."""
    known = teff_known if teff_known is not None else F.lit(None).cast("double")
    colour, m_g = bp_rp(), absolute_mag()
    both = colour.isNotNull() & m_g.isNotNull()
    mass = F.when(both, hr_mass(colour, m_g)).otherwise(fallback_mass(known, colour))
    return F.struct(
        mass.alias("initial_mass"),
        log_g(mass).alias("log_g"),
        F.round(F.when(both, teff(colour)).otherwise(F.coalesce(known, F.lit(5778.0))), 0).alias("teff_k"),
        metallicity().alias("initial_z"),
        F.round(colour, 4).alias("bp_rp"),
        F.round(m_g, 3).alias("abs_mag_g"),
        F.col("ruwe").alias("ruwe"),
        F.coalesce(total_motion() > 80, F.lit(False)).alias("high_motion"),
        F.when(both, "hr_diagram").otherwise("photometry_heuristic").alias("method"),
    )


def deredden(ebv=0.05) -> Column:
    """Struct of A_V, A_G, E(BP-RP) and the corrected magnitude and colour."""
    av = 3.1 * F.coalesce(col(ebv), F.lit(0.05))
    return F.struct(F.round(av, 3).alias("a_v"), F.round(0.86 * av, 3).alias("a_g"), F.round(0.41 * av, 3).alias("e_bp_rp"), F.round(F.col("phot_g_mean_mag") - 0.86 * av, 3).alias("g_corrected"), F.round(bp_rp() - 0.41 * av, 3).alias("bp_rp_corrected"))


# Effective wavelength in micrometres and zero point in jansky of each filter.
FILTERS = {
    "phot_g_mean_mag": (0.673, 3228.75),
    "phot_bp_mean_mag": (0.532, 3552.01),
    "phot_rp_mean_mag": (0.797, 2554.95),
    "Jmag": (1.235, 1594.0),
    "Hmag": (1.662, 1024.0),
    "Kmag": (2.159, 666.7),
    "W1mag": (3.352, 309.54),
    "W2mag": (4.603, 171.78),
}


def flux_jy(magnitude, filter_name: str) -> Column:
    return FILTERS[filter_name][1] * F.pow(F.lit(10.0), -0.4 * col(magnitude))


def sed(columns: list[str]) -> Column:
    """Array of (wavelength_um, flux_jy, filter) of the magnitudes at hand, by wavelength."""
    points = [F.when(F.col(c).isNotNull(), F.struct(F.lit(FILTERS[c][0]).alias("wavelength_um"), F.round(flux_jy(c, c), 4).alias("flux_jy"), F.lit(c).alias("filter"))) for c in columns if c in FILTERS]
    return F.array_sort(F.array_compact(F.array(*points)))


def wien_teff(points) -> Column:
    """Temperature whose black body peaks where the SED does."""
    peak = F.array_max(F.transform(col(points), lambda p: F.struct(p["flux_jy"].alias("f"), (-p["wavelength_um"]).alias("w"))))
    return F.round(2898.0 / -peak["w"], 0)


def snr_penalty(value, error) -> Column:
    v, e = col(value), col(error)
    snr = F.try_divide(F.abs(v), F.abs(e))
    return F.when(v.isNull() | e.isNull(), 0.7).when(e <= 0, 1.0).when(snr >= 10, 1.0).when(snr <= 1, 0.3).otherwise(0.3 + 0.7 * (snr - 1) / 9.0)


def confidence(score) -> Column:
    """Struct of confidence and score_uncertainty from the measurement errors."""
    ruwe = F.col("ruwe")
    quality = F.coalesce(bands(ruwe, [(1.2, F.lit(1.0)), (1.4, F.lit(0.9)), (2.0, F.lit(0.7))], F.lit(0.5)), F.lit(0.6))
    phot = F.when(F.col("phot_g_mean_mag").isNotNull(), 0.9).otherwise(0.5)
    c = snr_penalty("parallax", "parallax_error") * 0.30 + snr_penalty("pmra", "pmra_error") * 0.15 + snr_penalty("pmdec", "pmdec_error") * 0.15 + phot * 0.15 + quality * 0.25
    return F.struct(F.round(c, 3).alias("confidence"), F.round(col(score) * (1 - c), 1).alias("score_uncertainty"))


def physical_anomaly() -> Column:
    """Fast, badly fitted, or of extreme colour; missing values are no anomaly."""
    colour = bp_rp()
    return F.coalesce(total_motion() >= 150, F.lit(False)) | F.coalesce(F.col("ruwe") >= 2.0, F.lit(False)) | F.coalesce((colour >= 3.0) | (colour <= -0.2), F.lit(False))


def anomaly_types() -> Column:
    """Names of the six anomaly criteria that a star meets."""
    colour, m_g, d = bp_rp(), absolute_mag(), F.when(F.col("parallax") > 0, 1000.0 / F.col("parallax"))
    rules = [
        ("high_proper_motion", total_motion() >= 100),
        ("high_ruwe", F.col("ruwe") >= 1.8),
        ("extreme_blue", colour <= -0.1),
        ("extreme_red", colour >= 2.8),
        ("overluminous", (F.col("phot_g_mean_mag") < 10) & (d > 500)),
        ("white_dwarf_candidate", (m_g > 10) & F.coalesce(colour < 1.5, F.lit(True))),
    ]
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
