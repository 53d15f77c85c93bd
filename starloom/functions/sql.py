"""The column functions as temporary SQL functions, and functions that return tables; the analyser inlines them, so plans see through them.

``register_sql_functions`` makes the scalar ones, ``register_table_functions`` those over a table of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.stellar import FILTERS
from starloom.functions.text import CLUSTERS, GAIA
from starloom.sources.exports import UNITS

_H = "(pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2))"
_STEPS = "CASE WHEN {0} IS NULL THEN NULL {1} ELSE {2} END"


def _bands(x: str, steps: list, last) -> str:
    """Results below rising bounds, the last beyond them; null stays null."""
    return _STEPS.format(x, " ".join(f"WHEN {x} < {bound} THEN {result}" for bound, result in steps), last)


def _case(x: str, results: dict, last) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in results.items()) + f" ELSE {last} END"


_POINT = "ARRAY<STRUCT<wavelength_um: DOUBLE, flux_jy: DOUBLE, filter: STRING>>"
_MAGS = {c: c.lower() for c in FILTERS}
_SED = ", ".join(f"CASE WHEN {m} IS NOT NULL THEN struct({FILTERS[c][0]}D AS wavelength_um, round(flux_jy({m}, '{c}'), 4) AS flux_jy, '{c}' AS filter) END" for c, m in _MAGS.items())
_ICRS = "lower(trim(coalesce(frame, ''))) = 'galactic'"
_B, _DL = "radians(lat)", "radians(122.93192D - lon)"
_SIN, _COS = "sin(radians(27.12825D))", "cos(radians(27.12825D))"
_S = f"({_SIN} * sin({_B}) + {_COS} * cos({_B}) * cos({_DL}))"
_POP = {
    "blue": _bands("m_g", [(2, "'Blue Supergiant'"), (5, "'Blue Straggler'")], "'Hot Subdwarf'"),
    "white": _bands("m_g", [(4, "'Main Sequence (O-B)'")], "'White Dwarf Candidate'"),
    "yellow": _bands("m_g", [(4, "'Giant/Subgiant'"), (6, "'Main Sequence (A-F)'")], "'Main Sequence (G)'"),
    "orange": _bands("m_g", [(5, "'K Giant'"), (9, "'Main Sequence (K)'")], "'K Dwarf'"),
    "red": _bands("m_g", [(5, "'M Giant'"), (10, "'M Dwarf'")], "'Brown Dwarf Candidate'"),
}
_PARAMETERS = "STRUCT<initial_mass: DOUBLE, log_g: DOUBLE, teff_k: DOUBLE, initial_z: DOUBLE, bp_rp: DOUBLE, abs_mag_g: DOUBLE, ruwe: DOUBLE, high_motion: BOOLEAN, method: STRING>"
_BOTH = "bp_rp(bp, rp) IS NOT NULL AND absolute_mag(g, parallax) IS NOT NULL"
_MASS = f"CASE WHEN {_BOTH} THEN hr_mass(bp_rp(bp, rp), absolute_mag(g, parallax)) ELSE fallback_mass(teff_known, bp_rp(bp, rp)) END"
_EAST = "pmod(ra, 360D) / 15 * 3600"
_CONFIDENCE = "(snr_penalty(parallax, parallax_error) * 0.30D + snr_penalty(pmra, pmra_error) * 0.15D + snr_penalty(pmdec, pmdec_error) * 0.15D + CASE WHEN g IS NOT NULL THEN 0.9D ELSE 0.5D END * 0.15D + coalesce(" + _bands("ruwe", [(1.2, "1.0D"), (1.4, "0.9D"), (2.0, "0.7D")], "0.5D") + ", 0.6D) * 0.25D)"

#: name: (arguments, what it returns, body). Later ones may use earlier ones.
FUNCTIONS = {
    "as_finite": ("x STRING", "DOUBLE", "CASE WHEN NOT isnan(try_cast(x AS DOUBLE)) AND abs(try_cast(x AS DOUBLE)) <> double('infinity') THEN try_cast(x AS DOUBLE) END"),
    "object_class_of": ("x STRING", "STRING", r"upper(nullif(trim(regexp_replace(translate(x, '_/', '  '), '\\s+', ' ')), ''))"),
    "catalog_of": ("x STRING, missing STRING", "STRING", "replace(upper(coalesce(nullif(trim(x), ''), missing)), ' ', '-')"),
    "sky_sep": ("ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE", "DOUBLE", f"degrees(2 * asin(sqrt(CASE WHEN {_H} > 1 THEN 1D ELSE {_H} END)))"),
    "in_cone": ("ra DOUBLE, dec DOUBLE, ra0 DOUBLE, dec0 DOUBLE, r DOUBLE", "BOOLEAN", "coalesce(ra IS NOT NULL AND dec BETWEEN dec0 - r AND dec0 + r AND sky_sep(ra, dec, ra0, dec0) <= r, false)"),
    "radius_in_deg": ("value DOUBLE, unit STRING", "DOUBLE", "value / CASE lower(trim(coalesce(unit, 'deg'))) WHEN 'arcmin' THEN 60D WHEN 'arcsec' THEN 3600D ELSE 1D END"),
    "icrs_ra": ("lon DOUBLE, lat DOUBLE, frame STRING", "DOUBLE", f"CASE WHEN {_ICRS} THEN pmod(192.85948D + degrees(atan2(cos({_B}) * sin({_DL}), {_COS} * sin({_B}) - {_SIN} * cos({_B}) * cos({_DL}))), 360D) ELSE lon END"),
    "icrs_dec": ("lon DOUBLE, lat DOUBLE, frame STRING", "DOUBLE", f"CASE WHEN {_ICRS} THEN degrees(asin(CASE WHEN {_S} > 1 THEN 1D WHEN {_S} < -1 THEN -1D ELSE {_S} END)) ELSE lat END"),
    "to_cartesian": ("ra DOUBLE, dec DOUBLE, distance DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>", "struct(distance * cos(radians(dec)) * cos(radians(ra)) AS x, distance * sin(radians(dec)) AS y, distance * cos(radians(dec)) * sin(radians(ra)) AS z)"),
    "from_cartesian": ("x DOUBLE, y DOUBLE, z DOUBLE", "STRUCT<ra: DOUBLE, dec: DOUBLE, distance: DOUBLE>", "CASE WHEN x * x + y * y + z * z > 0 THEN struct(pmod(degrees(atan2(z, x)) + 360, 360D) AS ra, degrees(asin(greatest(-1D, least(1D, y / sqrt(x * x + y * y + z * z))))) AS dec, sqrt(x * x + y * y + z * z) AS distance) END"),
    "distance_pc": ("parallax DOUBLE", "DOUBLE", "CASE WHEN parallax > 0 THEN 1000 / parallax END"),
    "light_years": ("parsec DOUBLE", "DOUBLE", "parsec * 3.26156D"),
    "bp_rp": ("bp DOUBLE, rp DOUBLE", "DOUBLE", "bp - rp"),
    "total_motion": ("pmra DOUBLE, pmdec DOUBLE", "DOUBLE", "nullif(sqrt(coalesce(pow(pmra, 2), 0D) + coalesce(pow(pmdec, 2), 0D)), 0D)"),
    "absolute_mag": ("g DOUBLE, parallax DOUBLE", "DOUBLE", "CASE WHEN parallax > 0 THEN g + 5 + 5 * log10(parallax / 1000) END"),
    "absolute_mag_error": ("g_error DOUBLE, parallax DOUBLE, parallax_error DOUBLE", "DOUBLE", "CASE WHEN parallax > 0 THEN round(sqrt(pow(coalesce(g_error, 0.01D), 2) + pow(5 / ln(10D) * coalesce(parallax_error, 0.01D) / parallax, 2)), 3) END"),
    "teff_error": ("bp_error DOUBLE, rp_error DOUBLE", "DOUBLE", "sqrt(pow(bp_error, 2) + pow(rp_error, 2)) * 10000"),
    "binary_separation": ("ruwe DOUBLE, parallax DOUBLE", "DOUBLE", "CASE WHEN ruwe > 1 AND parallax > 0 THEN (ruwe - 1) * (1000 / parallax) * 0.5D ELSE 0D END"),
    "angular_size_pc": ("radius_deg DOUBLE, parallax DOUBLE", "DOUBLE", "CASE WHEN parallax > 0 THEN radians(radius_deg) * 1000 / parallax END"),
    "population5": ("colour DOUBLE, m_g DOUBLE", "STRING", "CASE WHEN m_g < 3 AND colour < 0.8D THEN 'Main Sequence (O/B/A)' WHEN m_g < 1 AND colour > 1.2D THEN 'Giant Branch' WHEN m_g > 10 THEN 'White Dwarf Candidate' WHEN colour > 2.5D THEN 'M-Dwarf / Low Mass' WHEN m_g IS NOT NULL AND colour IS NOT NULL THEN 'Main Sequence' END"),
    "population14": ("colour DOUBLE, m_g DOUBLE", "STRING", "coalesce(" + _bands("colour", [("-0.2D", _POP["blue"]), ("0.5D", _POP["white"]), ("1.6D", _POP["yellow"]), ("2.7D", _POP["orange"])], _POP["red"]) + ", 'Unknown')"),
    "teff_of": ("c DOUBLE", "DOUBLE", "CASE WHEN c <= -0.1D THEN 20000D ELSE " + _bands("c", [("0.2D", "9200 - 7000 * (c + 0.1D) / 0.3D"), ("0.6D", "7200 - 2000 * (c - 0.2D) / 0.4D"), ("1.2D", "5800 - 1800 * (c - 0.6D) / 0.6D"), ("2.1D", "4200 - 1600 * (c - 1.2D) / 0.9D")], "3000D") + " END"),
    "hr_mass": ("colour DOUBLE, m_g DOUBLE", "DOUBLE", "round(greatest(0.08D, least(20D, nullif(pow(10D, " + _bands("colour", [("-0.2D", "0.25D * m_g - 1.5D"), ("0.0D", "0.17D * m_g - 0.9D"), ("0.6D", "0.27D * m_g - 1.3D"), ("1.4D", "0.25D * m_g - 1.0D")], "0.2D * m_g - 0.5D") + "), -1D))), 2) * CASE WHEN colour IS NULL OR m_g IS NULL THEN NULL ELSE 1 END"),
    "log_g_of": ("mass DOUBLE", "DOUBLE", _bands("mass", [("0.8D", "4.6D"), ("1.2D", "4.4D"), ("2.5D", "4.3D")], "4D")),
    "metallicity_of": ("catalog STRING", "DOUBLE", "CASE WHEN contains(upper(coalesce(catalog, '')), 'SMC') THEN 0.004D WHEN contains(upper(coalesce(catalog, '')), 'LMC') THEN 0.008D ELSE 0.02D END"),
    "fallback_mass": ("teff DOUBLE, colour DOUBLE", "DOUBLE", "coalesce(" + _bands("teff", [(5000, "0.75D"), (6000, "0.95D"), (7500, "1.15D"), (9000, "1.7D")], "2.2D") + ", CASE WHEN colour <= 0 THEN 1.8D WHEN colour <= 0.6D THEN 1.2D WHEN colour <= 1.4D THEN 0.95D WHEN colour IS NOT NULL THEN 0.75D END, 1D)"),
    "physical_parameters": ("g DOUBLE, bp DOUBLE, rp DOUBLE, parallax DOUBLE, pmra DOUBLE, pmdec DOUBLE, ruwe DOUBLE, catalog STRING, teff_known DOUBLE", _PARAMETERS, f"struct({_MASS} AS initial_mass, log_g_of({_MASS}) AS log_g, round(CASE WHEN {_BOTH} THEN teff_of(bp_rp(bp, rp)) ELSE coalesce(teff_known, 5778D) END, 0) AS teff_k, metallicity_of(catalog) AS initial_z, round(bp_rp(bp, rp), 4) AS bp_rp, round(absolute_mag(g, parallax), 3) AS abs_mag_g, ruwe AS ruwe, coalesce(total_motion(pmra, pmdec) > 80, false) AS high_motion, CASE WHEN {_BOTH} THEN 'hr_diagram' ELSE 'photometry_heuristic' END AS method)"),
    "deredden": ("g DOUBLE, bp DOUBLE, rp DOUBLE, ebv DOUBLE", "STRUCT<a_v: DOUBLE, a_g: DOUBLE, e_bp_rp: DOUBLE, g_corrected: DOUBLE, bp_rp_corrected: DOUBLE>", "struct(round(3.1D * coalesce(ebv, 0.05D), 3) AS a_v, round(0.86D * (3.1D * coalesce(ebv, 0.05D)), 3) AS a_g, round(0.41D * (3.1D * coalesce(ebv, 0.05D)), 3) AS e_bp_rp, round(g - 0.86D * (3.1D * coalesce(ebv, 0.05D)), 3) AS g_corrected, round(bp_rp(bp, rp) - 0.41D * (3.1D * coalesce(ebv, 0.05D)), 3) AS bp_rp_corrected)"),
    "flux_jy": ("magnitude DOUBLE, filter STRING", "DOUBLE", "pow(10D, -0.4D * magnitude) * " + _case("filter", {c: f"{zero}D" for c, (_, zero) in FILTERS.items()}, "NULL")),
    "sed": (", ".join(f"{m} DOUBLE" for m in _MAGS.values()), _POINT, f"array_sort(array_compact(array({_SED})))"),
    "wien_teff": (f"points {_POINT}", "DOUBLE", "round(2898D / -array_max(transform(points, p -> struct(p.flux_jy AS f, -p.wavelength_um AS w))).w, 0)"),
    "ra_text": ("ra DOUBLE", "STRING", f"format_string('%02d:%02d:%07.4f', CAST(floor(round({_EAST}, 4) / 3600) AS BIGINT), CAST(floor(pmod(round({_EAST}, 4), 3600D) / 60) AS BIGINT), pmod(round({_EAST}, 4), 60D))"),
    "dec_text": ("dec DOUBLE", "STRING", "format_string('%s%02d.%02d.%06.3f', CASE WHEN dec < 0 THEN '-' ELSE '+' END, CAST(floor(round(abs(dec) * 3600, 3) / 3600) AS BIGINT), CAST(floor(pmod(round(abs(dec) * 3600, 3), 3600D) / 60) AS BIGINT), pmod(round(abs(dec) * 3600, 3), 60D))"),
    "snr_penalty": ("value DOUBLE, error DOUBLE", "DOUBLE", "CASE WHEN value IS NULL OR error IS NULL THEN 0.7D WHEN error <= 0 THEN 1D WHEN abs(value) / abs(error) >= 10 THEN 1D WHEN abs(value) / abs(error) <= 1 THEN 0.3D ELSE 0.3D + 0.7D * (abs(value) / abs(error) - 1) / 9 END"),
    "confidence": ("score DOUBLE, g DOUBLE, parallax DOUBLE, parallax_error DOUBLE, pmra DOUBLE, pmra_error DOUBLE, pmdec DOUBLE, pmdec_error DOUBLE, ruwe DOUBLE", "STRUCT<confidence: DOUBLE, score_uncertainty: DOUBLE>", f"struct(round({_CONFIDENCE}, 3) AS confidence, round(score * (1 - {_CONFIDENCE}), 1) AS score_uncertainty)"),
    "mjd": ("t TIMESTAMP", "DOUBLE", "unix_micros(t) / 86400000000D + 40587"),
    "from_mjd": ("value DOUBLE", "TIMESTAMP", "timestamp_micros(CAST(round((value - 40587) * 86400000000D) AS BIGINT))"),
    "arxiv_id": ("text STRING, file_name STRING", "STRING", r"coalesce(nullif(regexp_extract(substring(text, 1, 5000), 'arXiv:(\\d{4}\\.\\d{4,5})', 1), ''), file_name)"),
    "abstract_of": ("text STRING", "STRING", r"left(trim(regexp_extract(text, '(?is)abstract[:\\s]+(.*?)(?=\\n\\s*\\n|introduction|keywords|$)', 1)), 2000)"),
    "title_line": ("text STRING", "STRING", r"get(filter(transform(split(left(text, 500), '\\n'), x -> trim(x)), x -> length(x) > 20 AND x RLIKE '^[A-Z]'), 0)"),
    "gaia_ids": ("text STRING", "ARRAY<STRING>", "array_distinct(regexp_extract_all(text, '" + GAIA.replace("\\", "\\\\") + "', 1))"),
    "unit_of": ("field STRING", "STRING", _case("field", {c: f"'{u}'" for c, u in UNITS.items()}, "NULL")),
    "preview": ("text STRING, n INT", "STRING", "left(text, n)"),
    "named_cluster": ("alias STRING", "STRING", "CASE " + " ".join(f"WHEN lower(alias) IN ({', '.join(repr(a) for a in aliases)}) THEN '{name}'" for name, aliases in CLUSTERS.items()) + " END"),
    "sky_zone": ("dec DOUBLE, height DOUBLE", "BIGINT", "CAST(floor((dec + 90) / height) AS BIGINT)"),
    "sky_cells": ("zone BIGINT, height DOUBLE, radius DOUBLE", "BIGINT", "CASE WHEN greatest(abs((zone - 1) * height - 90), abs((zone + 2) * height - 90)) + radius >= 90 THEN 1L ELSE greatest(1L, CAST(floor(360 / degrees(atan(sin(radians(radius)) / sqrt(abs(cos(radians(greatest(abs((zone - 1) * height - 90), abs((zone + 2) * height - 90)) - radius)) * cos(radians(greatest(abs((zone - 1) * height - 90), abs((zone + 2) * height - 90)) + radius))))))) AS BIGINT)) END"),
    "sky_cell": ("ra DOUBLE, cells BIGINT", "BIGINT", "least(cells - 1, CAST(floor(pmod(ra, 360D) / 360 * cells) AS BIGINT))"),
}

_STARS, _SCORES = "sky_stars", "sky_scores"
_FAR = "greatest(abs((zone - 1) * height - 90), abs((zone + 2) * height - 90))"
#: Degrees of right ascension that the radius r covers at most around a zone; 360 where it may cover a pole.
_REACH = f"CASE WHEN {_FAR} + r >= 90 THEN 360D ELSE 1e-9D + degrees(atan(sin(radians(r)) / sqrt(abs(cos(radians({_FAR} - r)) * cos(radians({_FAR} + r)))))) END"
#: name: (arguments, columns, query). They read the views that ``register_table_functions`` makes.
TABLES = {
    "cone": (
        "ra0 DOUBLE, dec0 DOUBLE, r DOUBLE",
        "source_id STRING, ra DOUBLE, dec DOUBLE, phot_g_mean_mag DOUBLE, sep_deg DOUBLE",
        f"SELECT source_id, ra, dec, phot_g_mean_mag, sky_sep(ra, dec, ra0, dec0) FROM {_STARS} WHERE ra IS NOT NULL AND dec >= dec0 - r AND dec <= dec0 + r AND sky_sep(ra, dec, ra0, dec0) <= r",
    ),
    "sky_pairs": (
        "r DOUBLE",
        "source_id STRING, catalog STRING, source_id_b STRING, catalog_b STRING, sep_deg DOUBLE",
        # Zones are two radii high, as in ``crossmatch.sky_join``: a row is copied to four cells on average, and neither side is broadcast.
        f"""WITH s AS (SELECT source_id, ra, dec, pmod(ra, 360D) AS east, catalog_of(catalog_source, 'UNKNOWN') AS catalog, greatest(2 * r, 1e-4D) AS height FROM {_STARS} WHERE ra IS NOT NULL AND dec IS NOT NULL),
        v AS (SELECT *, sky_zone(dec - r - 1e-9D, height) AS low, sky_zone(dec + r + 1e-9D, height) AS high FROM s),
        w AS (SELECT *, explode(sequence(low, high)) AS zone FROM v),
        x AS (SELECT *, {_REACH} AS reach FROM w),
        y AS (SELECT *, CASE WHEN reach >= 360 THEN 1L ELSE greatest(1L, CAST(floor(180 / reach) AS BIGINT)) END AS cells FROM x),
        z AS (SELECT *, CAST(floor((east - reach) / 360 * cells) AS BIGINT) AS first, CAST(floor((east + reach) / 360 * cells) AS BIGINT) AS last FROM y),
        a AS (SELECT source_id, catalog, ra, dec, zone, pmod(cell, cells) AS cell FROM (SELECT *, explode(sequence(first, least(last, first + cells - 1))) AS cell FROM z)),
        t AS (SELECT *, sky_zone(dec, height) AS zone FROM s),
        u AS (SELECT *, {_REACH} AS reach FROM t),
        b AS (SELECT source_id, catalog, ra, dec, zone, sky_cell(ra, CASE WHEN reach >= 360 THEN 1L ELSE greatest(1L, CAST(floor(180 / reach) AS BIGINT)) END) AS cell FROM u)
        SELECT /*+ MERGE(b) */ a.source_id, a.catalog, b.source_id, b.catalog, sky_sep(a.ra, a.dec, b.ra, b.dec) FROM a JOIN b ON a.zone = b.zone AND a.cell = b.cell WHERE abs(a.dec - b.dec) <= r + 1e-9D AND sky_sep(a.ra, a.dec, b.ra, b.dec) <= r""",
    ),
    "overlap": (
        "arcsec DOUBLE",
        "c1 STRING, c2 STRING, matches BIGINT",
        "SELECT catalog, catalog_b, count(DISTINCT source_id) FROM sky_pairs(arcsec / 3600) WHERE catalog < catalog_b GROUP BY catalog, catalog_b",
    ),
    "ranking": (
        "n INT, how STRING",
        "place INT, source_id STRING, score DOUBLE",
        f"SELECT place, source_id, base_score FROM (SELECT row_number() OVER (ORDER BY base_score DESC, source_id) AS place, source_id, base_score FROM {_SCORES} WHERE mode = how) WHERE place <= n",
    ),
}


class _Chunks:
    """Overlapping pieces of a text that end at the last full stop beyond four fifths of their size."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        from starloom.operators.documents import pieces

        yield from enumerate(pieces(text, size, overlap))


def register_sql_functions(spark: SparkSession) -> None:
    """All scalar functions, and ``text_chunks(text, size, overlap)``, which returns (chunk_no, chunk) and runs in Python."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("text_chunks", F.udtf(_Chunks, returnType="chunk_no: int, chunk: string"))


def register_table_functions(spark: SparkSession, stars: DataFrame) -> None:
    """``cone``, ``sky_pairs``, ``overlap`` and ``ranking`` over a table of stars; registering again takes another table."""
    from functools import reduce

    from starloom.operators.discovery import base_score
    from starloom.operators.profiles import WEIGHTS, profile

    register_sql_functions(spark)
    stars.createOrReplaceTempView(_STARS)
    scored = [base_score(stars, profile(m)).select("source_id", "base_score").withColumn("mode", F.lit(m)) for m in WEIGHTS]
    reduce(DataFrame.unionByName, scored).createOrReplaceTempView(_SCORES)
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
