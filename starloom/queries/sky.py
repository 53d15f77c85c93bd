"""Queries of cones, cross-matches, discovery and physics, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import sky, stellar
from starloom.functions.columns import normalize_object_class
from starloom.operators import cone, crossmatch, discovery
from starloom.operators.profiles import perturbed, profile
from starloom.plans.fixtures import alerts, regions, stars, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sep(r1: str, d1: str, r2: str, d2: str) -> str:
    return f"degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(({d2}) - ({d1})) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians(({r2}) - ({r1})) / 2), 2)))))"


W = with_views("stars")
CATALOG = "upper(coalesce(nullif(trim(catalog_source), ''), 'GAIA'))"
COLOUR = "(phot_bp_mean_mag - phot_rp_mean_mag)"
MOTION = "nullif(sqrt(coalesce(pmra * pmra, 0) + coalesce(pmdec * pmdec, 0)), 0)"
M_G = "CASE WHEN parallax > 0 THEN phot_g_mean_mag + 5 + 5 * log10(parallax / 1000.0) END"


def near(radius: float) -> str:
    """All ordered pairs within a radius: a zone join that is independent of the cells under test."""
    return f"""z AS (SELECT *, CAST(floor((dec + 90) / {radius}) AS BIGINT) AS zone FROM stars WHERE ra IS NOT NULL AND dec IS NOT NULL),
a AS (SELECT *, unnest([zone - 1, zone, zone + 1]) AS zz FROM z),
pairs AS (SELECT a.source_id AS a_id, b.source_id AS b_id, a.catalog_source AS a_cat, b.catalog_source AS b_cat, {sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS sep FROM a JOIN z b ON a.zz = b.zone WHERE {sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= {radius})"""


_CONE = f"""{W}, c AS (SELECT *, {sep('ra', 'dec', '66.75', '15.87')} AS d FROM stars WHERE ra IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY round(coalesce(ra, 0), 8), round(coalesce(dec, 0), 8), round(parallax, 6), round(phot_g_mean_mag, 6), round(phot_bp_mean_mag, 6), round(phot_rp_mean_mag, 6), catalog_source ORDER BY d, source_id) AS n FROM c WHERE d <= 10)
"""


@query("cone_search", _CONE + "SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, phot_g_mean_mag, round(d, 6) AS distance_deg FROM f WHERE n = 1 ORDER BY d, source_id LIMIT 100")
def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cone.cone_search(stars(spark, sf_dir), 66.75, 15.87, 10.0, 100)
    return found.select("source_id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), "phot_g_mean_mag", F.round("distance_deg", 6).alias("distance_deg"))


@query("radial_search", _CONE.replace("WHERE d <= 10", "WHERE d <= 10 AND phot_g_mean_mag <= 15 AND parallax >= 1") + "SELECT source_id, round(d, 6) AS distance_deg FROM f WHERE n = 1 ORDER BY d, source_id LIMIT 50")
def radial_search(spark, sf_dir):
    return cone.radial_search(stars(spark, sf_dir), 66.75, 15.87, 10.0, 15.0, 1.0, 50).select("source_id", F.round("distance_deg", 6).alias("distance_deg"))


@query("cone_scored", f"""{W} SELECT source_id, CASE WHEN is_transient = 1 THEN 15.0 ELSE 0.0 END + CASE WHEN ruwe >= 1.4 THEN 9.0 ELSE 0.0 END + CASE WHEN {COLOUR} <= -0.1 OR {COLOUR} >= 2.8 THEN 10.5 ELSE 0.0 END AS discovery_score,
CAST((CASE WHEN is_transient = 1 THEN 1 ELSE 0 END) + (CASE WHEN ruwe >= 1.4 THEN 1 ELSE 0 END) + (CASE WHEN {COLOUR} <= -0.1 OR {COLOUR} >= 2.8 THEN 1 ELSE 0 END) AS INTEGER) AS n_reasons FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '83.82', '-5.39')} <= 8""")
def cone_scored(spark, sf_dir):
    near_orion = stars(spark, sf_dir).where(sky.in_cone("ra", "dec", 83.82, -5.39, 8.0))
    return cone.score_cone(near_orion).select("source_id", "discovery_score", F.size("discovery_reasons").alias("n_reasons"))


@query("star_lookup", f"{W} SELECT source_id, ra, dec, parallax FROM stars WHERE source_id = '100000000000000042'")
def star_lookup(spark, sf_dir):
    return cone.lookup(stars(spark, sf_dir), "100000000000000042").select("source_id", "ra", "dec", "parallax")


@query("star_nearby", f"{W}, c AS (SELECT ra AS r0, dec AS d0 FROM stars WHERE source_id = '100000000000000042') SELECT source_id, round({sep('r0', 'd0', 'ra', 'dec')}, 6) AS distance_deg FROM stars, c WHERE source_id <> '100000000000000042' AND ra IS NOT NULL AND {sep('r0', 'd0', 'ra', 'dec')} <= 0.5 ORDER BY {sep('r0', 'd0', 'ra', 'dec')}, source_id LIMIT 50")
def star_nearby(spark, sf_dir):
    return cone.nearby(stars(spark, sf_dir), "100000000000000042", 0.5).select("source_id", F.round("distance_deg", 6).alias("distance_deg"))


@query("volume_filter", f"{W} SELECT source_id, parallax, phot_g_mean_mag FROM stars WHERE parallax > 0 AND phot_g_mean_mag <= 18 ORDER BY coalesce(phot_g_mean_mag, 99), parallax DESC, source_id LIMIT 500")
def volume_filter(spark, sf_dir):
    return cone.volume_filter(stars(spark, sf_dir), 500, mag_limit=18.0).select("source_id", "parallax", "phot_g_mean_mag")


_PM = "sqrt(pmra * pmra + pmdec * pmdec)"


@query("high_velocity", f"{W} SELECT source_id, round({_PM}, 6) AS pm_total FROM stars WHERE {_PM} > 100 AND (parallax IS NULL OR parallax / nullif(parallax_error, 0) > 5) AND phot_g_mean_mag < 16")
def high_velocity(spark, sf_dir):
    return cone.high_velocity(stars(spark, sf_dir), limit=None).select("source_id", F.round("pm_total", 6).alias("pm_total"))


@query("binary_candidates", f"{W} SELECT source_id, ruwe FROM stars WHERE ruwe > 1.4 AND parallax > 5 ORDER BY ruwe DESC, source_id LIMIT 100")
def binary_candidates(spark, sf_dir):
    return cone.binary_candidates(stars(spark, sf_dir)).select("source_id", "ruwe")


@query("custom_where", f"{W} SELECT source_id FROM stars WHERE ruwe > 2 AND phot_g_mean_mag < 12 ORDER BY source_id LIMIT 100")
def custom_where(spark, sf_dir):
    return cone.custom_where(stars(spark, sf_dir), "ruwe > 2 AND phot_g_mean_mag < 12").select("source_id")


@query("candidate_filter", f"{W} SELECT source_id FROM stars WHERE ruwe >= 1.5 AND {COLOUR} < 2 AND {_PM} >= 50 AND parallax > 0 AND 1000 / nullif(parallax, 0) <= 500 AND phot_g_mean_mag <= 15")
def candidate_filter(spark, sf_dir):
    return cone.candidate_filter(stars(spark, sf_dir), min_ruwe=1.5, max_bp_rp=2.0, min_pm=50.0, max_distance=500.0, max_g=15.0).select("source_id")


@query("hr_quality_cut", f"{W} SELECT source_id FROM stars WHERE CASE WHEN parallax_error > 0 THEN parallax / nullif(parallax_error, 0) >= 5 ELSE parallax > 0 END")
def hr_quality_cut(spark, sf_dir):
    return cone.hr_quality_cut(stars(spark, sf_dir)).select("source_id")


@query("anomalies", f"""{W} SELECT source_id, coalesce({MOTION} >= 150, false) OR coalesce(ruwe >= 2.0, false) OR coalesce({COLOUR} >= 3.0 OR {COLOUR} <= -0.2, false) AS anomaly,
 CAST(coalesce({MOTION} >= 100, false)::INT + coalesce(ruwe >= 1.8, false)::INT + coalesce({COLOUR} <= -0.1, false)::INT + coalesce({COLOUR} >= 2.8, false)::INT + coalesce(phot_g_mean_mag < 10 AND parallax > 0 AND 1000 / nullif(parallax, 0) > 500, false)::INT + coalesce(({M_G}) > 10 AND coalesce({COLOUR} < 1.5, true), false)::INT AS INTEGER) AS n_types FROM stars""")
def anomalies(spark, sf_dir):
    return stars(spark, sf_dir).select("source_id", stellar.physical_anomaly().alias("anomaly"), F.size(stellar.anomaly_types()).alias("n_types"))


@query("sky_join", f"{W}, {near(0.08)} SELECT a_id AS source_id, b_id AS source_id_b, round(sep, 6) AS sep_deg FROM pairs WHERE a_id <> b_id")
def sky_join(spark, sf_dir):
    s = stars(spark, sf_dir).select("source_id", "ra", "dec")
    return crossmatch.sky_join(s, s, 0.08).where("source_id <> source_id_b").select("source_id", "source_id_b", F.round("sep_deg", 6).alias("sep_deg"))


@query("neighbour_context", f"""{W}, {near(0.08)}, n AS (SELECT a_id, count(*) AS k, count(DISTINCT CASE WHEN upper(coalesce(nullif(trim(b_cat), ''), 'UNKNOWN')) <> replace(upper(coalesce(nullif(trim(a_cat), ''), 'GAIA')), ' ', '-') THEN upper(coalesce(nullif(trim(b_cat), ''), 'UNKNOWN')) END) AS m FROM pairs WHERE a_id <> b_id GROUP BY a_id)
SELECT source_id, coalesce(k, 0) AS local_density, CAST(coalesce(m, 0) AS INTEGER) AS n_catalogs FROM stars LEFT JOIN n ON a_id = source_id""")
def neighbour_context(spark, sf_dir):
    s = stars(spark, sf_dir)
    return crossmatch.neighbour_context(s, s).select("source_id", "local_density", F.size("matched_catalogs").alias("n_catalogs"))


_NAMED = "upper(coalesce(nullif(trim({0}), ''), 'UNKNOWN'))"


@query("catalog_overlap", f"""{W}, {near(0.02)}, k AS (SELECT {_NAMED.format('catalog_source')} AS c, count(*) AS n FROM stars GROUP BY 1),
m AS (SELECT {_NAMED.format('a_cat')} AS c1, {_NAMED.format('b_cat')} AS c2, count(DISTINCT a_id) AS matches FROM pairs GROUP BY 1, 2)
SELECT k1.c AS c1, k2.c AS c2, coalesce(matches, 0) AS matches, round(coalesce(matches, 0) / least(k1.n, k2.n), 6) AS fraction FROM k k1 JOIN k k2 ON k1.c < k2.c LEFT JOIN m ON k1.c = c1 AND k2.c = c2""")
def catalog_overlap(spark, sf_dir):
    return crossmatch.catalog_overlap(stars(spark, sf_dir), 72.0).withColumn("fraction", F.round("fraction", 6))


@query("catalog_unique", f"""{W}, {near(0.02)} SELECT {_NAMED.format('catalog_source')} AS catalog, count(*) FILTER (ra IS NOT NULL AND source_id NOT IN (SELECT a_id FROM pairs WHERE {_NAMED.format('a_cat')} <> {_NAMED.format('b_cat')})) AS unique_count FROM stars GROUP BY 1""")
def catalog_unique(spark, sf_dir):
    return crossmatch.catalog_unique(stars(spark, sf_dir), 72.0)


@query("multi_catalog", f"""{W}, {near(0.08)} SELECT a_id AS source_id FROM pairs WHERE a_id <> b_id AND {_NAMED.format('b_cat')} <> {CATALOG.replace('catalog_source', 'a_cat')} GROUP BY a_id HAVING count(DISTINCT {_NAMED.format('b_cat')}) + 1 >= 4""")
def multi_catalog(spark, sf_dir):
    return crossmatch.multi_catalog(stars(spark, sf_dir), 4).select("source_id")


WR = with_views("stars", "regions")
_IN = sep("s.ra", "s.dec", "r.ra", "r.dec")


@query("region_members", f"{WR} SELECT s.source_id, r.name AS region FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg")
def region_members(spark, sf_dir):
    return crossmatch.region_members(stars(spark, sf_dir), regions(spark)).select("source_id", "region")


@query("nearest_region", f"""{WR}, n AS (SELECT s.source_id, r.name, row_number() OVER (PARTITION BY s.source_id ORDER BY {_IN}, r.name) AS k FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= greatest(1.9 * r.radius_deg, 4.0))
SELECT s.source_id, coalesce(n.name, 'ML Cluster') AS label FROM stars s LEFT JOIN n ON n.source_id = s.source_id AND k = 1""")
def nearest_region(spark, sf_dir):
    return crossmatch.nearest_region(stars(spark, sf_dir), regions(spark)).select("source_id", "label")


@query("alert_matches", f"""{with_views('stars', 'alerts')}, z AS (SELECT *, CAST(floor((dec + 90) / 0.01) AS BIGINT) AS zone FROM stars WHERE ra IS NOT NULL), a AS (SELECT *, unnest([CAST(floor((dec + 90) / 0.01) AS BIGINT) - 1, CAST(floor((dec + 90) / 0.01) AS BIGINT), CAST(floor((dec + 90) / 0.01) AS BIGINT) + 1]) AS zz FROM alerts WHERE ra IS NOT NULL),
m AS (SELECT a.name, z.source_id, {sep('a.ra', 'a.dec', 'z.ra', 'z.dec')} AS d FROM a JOIN z ON zz = zone), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, source_id) AS k FROM m WHERE d <= 3.0 / 3600)
SELECT name, source_id, round(d * 3600, 4) AS separation_arcsec FROM r WHERE k <= 5""")
def alert_matches(spark, sf_dir):
    found = crossmatch.alert_matches(alerts(spark, sf_dir), stars(spark, sf_dir))
    return found.select("name", F.col("source_id_b").alias("source_id"), F.round("separation_arcsec", 4).alias("separation_arcsec"))


def _split(spark, sf_dir):
    s = stars(spark, sf_dir)
    return s.where("catalog_source IN ('gaia ', 'GAIA')"), s.where("catalog_source IN ('WISE', '2MASS')")


_XMATCH = f"""{W}, g AS (SELECT *, unnest([CAST(floor((dec + 90) / 0.05) AS BIGINT) - 1, CAST(floor((dec + 90) / 0.05) AS BIGINT), CAST(floor((dec + 90) / 0.05) AS BIGINT) + 1]) AS zz FROM stars WHERE ra IS NOT NULL AND catalog_source IN ('gaia ', 'GAIA')),
o AS (SELECT *, CAST(floor((dec + 90) / 0.05) AS BIGINT) AS zone FROM stars WHERE ra IS NOT NULL AND catalog_source IN ('WISE', '2MASS')),
m AS (SELECT g.source_id, o.source_id AS match_id, o.catalog_source AS catalog, {sep('g.ra', 'g.dec', 'o.ra', 'o.dec')} AS d FROM g JOIN o ON zz = zone), """


@query("xmatch_catalogs", _XMATCH + "k AS (SELECT *, row_number() OVER (PARTITION BY source_id, catalog ORDER BY d, match_id) AS n FROM m WHERE d <= 100.0 / 3600) SELECT source_id, catalog, CAST(n AS INTEGER) AS rank, match_id FROM k WHERE n <= 5")
def xmatch_catalogs(spark, sf_dir):
    gaia, other = _split(spark, sf_dir)
    tables = {c: other.where(F.col("catalog_source") == c).select("source_id", "ra", "dec") for c in ("WISE", "2MASS")}
    m = crossmatch.xmatch_catalogs(gaia, tables, 100.0).select("source_id", "catalog", F.explode("matches").alias("m"))
    return m.select("source_id", "catalog", F.col("m.rank").alias("rank"), F.col("m.match_id").alias("match_id"))


@query("cross_register", _XMATCH + "k AS (SELECT source_id, match_id, row_number() OVER (PARTITION BY source_id ORDER BY d, match_id) AS n FROM m WHERE d <= 100.0 / 3600) SELECT s.source_id, k.source_id IS NOT NULL AS validated, k.match_id AS main_id FROM stars s LEFT JOIN k ON k.source_id = s.source_id AND n = 1 WHERE s.catalog_source IN ('gaia ', 'GAIA')")
def cross_register(spark, sf_dir):
    gaia, other = _split(spark, sf_dir)
    authority = other.select(F.col("source_id").alias("main_id"), "ra", "dec", F.col("object_class").alias("otype"))
    return crossmatch.cross_register(gaia, authority, 100.0).select("source_id", "validated", "main_id")


@query("dust_grid", f"{W}, g AS (SELECT floor(ra / 10) AS i, floor(dec / 10) AS j, max(ruwe) / 10 AS ebv FROM stars WHERE ruwe > 2.5 GROUP BY 1, 2) SELECT source_id, round(coalesce(g.ebv, 0.05), 4) AS ebv, round(phot_g_mean_mag - 0.86 * (3.1 * coalesce(g.ebv, 0.05)), 3) AS g_corrected FROM stars LEFT JOIN g ON floor(ra / 10) = i AND floor(dec / 10) = j")
def dust_grid(spark, sf_dir):
    s = stars(spark, sf_dir)
    cell = [F.floor(F.col(c) / 10).alias(c) for c in ("ra", "dec")]
    grid = s.where("ruwe > 2.5").groupBy(*cell).agg((F.max("ruwe") / 10).alias("ebv")).select(F.col("ra") * 10, F.col("dec") * 10, "ebv").toDF("ra", "dec", "ebv")
    return crossmatch.with_ebv(s, grid, 10.0).select("source_id", F.round("ebv", 4).alias("ebv"), stellar.deredden("ebv")["g_corrected"].alias("g_corrected"))


# --- discovery -------------------------------------------------------------------------------------

_P = profile("balanced")
_FEATURES = f"""f AS (SELECT *, {CATALOG} AS catalog, CASE WHEN parallax > 0 THEN 1000.0 / parallax END AS d, {COLOUR} AS colour, {MOTION} AS pm FROM stars WHERE ra IS NOT NULL AND dec IS NOT NULL)"""
_POOL = """pool AS (SELECT * FROM (SELECT * FROM stars WHERE upper(trim(coalesce(catalog_source, 'GAIA'))) IN ('GAIA', '') ORDER BY coalesce(phot_g_mean_mag, 99), coalesce(parallax, -1) DESC, source_id LIMIT 3000) UNION ALL SELECT * FROM stars WHERE upper(trim(coalesce(catalog_source, 'GAIA'))) NOT IN ('GAIA', ''))"""


def _points(p: dict) -> str:
    rules = [
        ("catalog <> 'GAIA'", "catalog_bonus"), ("ruwe >= 2.0", "ruwe_high"), ("ruwe >= 1.4 AND ruwe < 2.0", "ruwe_elevated"), ("ruwe < 0.9", "ruwe_tight"), ("ruwe IS NULL", "ruwe_missing"),
        ("colour <= -0.1", "color_extreme"), ("colour >= 2.8", "color_extreme"), ("colour IS NULL AND catalog <> 'GAIA'", "no_color_profile"), ("pm >= 80", "motion_high"), ("pm >= 40 AND pm < 80", "motion_mid"),
        ("phot_g_mean_mag <= 10 AND d >= 500", "brightness_anomaly"), ("phot_g_mean_mag >= 16 AND d <= 50", "brightness_anomaly"),
    ]
    return " + ".join(f"CASE WHEN {rule} THEN {p[w]} ELSE 0.0 END" for rule, w in rules)


_BASE = f"{W}, {_FEATURES} SELECT source_id, catalog, round({_points(_P)}, 6) AS base_score FROM f"


@query("base_score", _BASE)
def base_score(spark, sf_dir):
    return discovery.base_score(stars(spark, sf_dir), _P).select("source_id", "catalog", F.round("base_score", 6).alias("base_score"))


def _ranked(p: dict, tail: str) -> str:
    pairs = near(0.08).replace("FROM stars WHERE ra IS NOT NULL", "FROM pool WHERE ra IS NOT NULL")
    return f"""{W}, {_POOL}, {_FEATURES.replace('FROM stars', 'FROM pool')}, b AS (SELECT *, {_points(p)} AS base FROM f),
w AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY base DESC, phot_g_mean_mag IS NOT NULL DESC, coalesce(phot_g_mean_mag, 99), source_id) AS place FROM b) WHERE place <= 60 OR catalog <> 'GAIA'),
{pairs}, n AS (SELECT a_id, count(*) AS k, count(DISTINCT CASE WHEN {_NAMED.format('b_cat')} <> {CATALOG.replace('catalog_source', 'a_cat')} THEN {_NAMED.format('b_cat')} END) AS m FROM pairs WHERE a_id <> b_id GROUP BY a_id),
c AS (SELECT w.*, coalesce(k, 0) AS k, coalesce(m, 0) AS m FROM w LEFT JOIN n ON a_id = source_id),
s AS (SELECT *, round(least(base + CASE WHEN k > 1 THEN least((k - 1) * {p['density_scale']}, {p['density_cap']}) ELSE 0.0 END + CASE WHEN m > 0 THEN least({p['cross_match_base']} + m * {p['cross_match_per_catalog']}, {p['cross_match_cap']}) ELSE 0.0 END
 + CASE WHEN catalog <> 'GAIA' THEN least(m * {p['catalog_overlap_bonus']}, {p['catalog_overlap_cap']}) ELSE 0.0 END, 100.0), 1) AS score FROM c) {tail}"""


def _snr(v: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {v}_error IS NULL THEN 0.7 WHEN {v}_error <= 0 THEN 1.0 WHEN abs({v}) / abs({v}_error) >= 10 THEN 1.0 WHEN abs({v}) / abs({v}_error) <= 1 THEN 0.3 ELSE 0.3 + 0.7 * (abs({v}) / abs({v}_error) - 1) / 9.0 END"


_CONF = f"({_snr('parallax')}) * 0.30 + ({_snr('pmra')}) * 0.15 + ({_snr('pmdec')}) * 0.15 + (CASE WHEN phot_g_mean_mag IS NOT NULL THEN 0.9 ELSE 0.5 END) * 0.15 + (CASE WHEN ruwe IS NULL THEN 0.6 WHEN ruwe < 1.2 THEN 1.0 WHEN ruwe < 1.4 THEN 0.9 WHEN ruwe < 2.0 THEN 0.7 ELSE 0.5 END) * 0.25"


@query("discovery_ranking", _ranked(_P, f"SELECT source_id, catalog AS catalog_source, k AS local_density, CAST(m AS INTEGER) AS n_catalogs, score, round({_CONF}, 3) AS confidence FROM s ORDER BY score DESC, d IS NOT NULL DESC, coalesce(phot_g_mean_mag, 99), source_id LIMIT 15"))
def discovery_ranking(spark, sf_dir):
    top = discovery.rank_discovery_candidates(stars(spark, sf_dir), limit=15)
    return top.select("source_id", "catalog_source", "local_density", F.size("matched_catalogs").alias("n_catalogs"), "score", "confidence")


@query("discovery_ranking_strict", _ranked(profile("strict"), "SELECT source_id, score FROM s ORDER BY score DESC, d IS NOT NULL DESC, coalesce(phot_g_mean_mag, 99), source_id LIMIT 15"))
def discovery_ranking_strict(spark, sf_dir):
    return discovery.rank_discovery_candidates(stars(spark, sf_dir), limit=15, mode="strict").select("source_id", "score")


@query("overlap_totals", _ranked(_P, "SELECT count(*) FILTER (m > 0) AS candidates_with_overlap, round(count(*) FILTER (m > 0) / count(*), 3) AS candidate_ratio FROM s"))
def overlap_totals(spark, sf_dir):
    return discovery.overlap_totals(discovery.scored_pool(stars(spark, sf_dir), 15, 3000, 0.08, _P))


@query("score_distribution", f"{W}, {_FEATURES}, b AS (SELECT {_points(_P)} AS x FROM f) SELECT count(*) AS n, count(*) FILTER (x > 0) AS non_zero, max(x) AS max_score, round(avg(x), 6) AS mean_score, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM b")
def score_distribution(spark, sf_dir):
    d = discovery.score_distribution(discovery.base_score(stars(spark, sf_dir), _P), "base_score")
    return d.withColumn("mean_score", F.round("mean_score", 6)).withColumn("rate", F.round("rate", 6))


@query("feature_importance", f"""{W}, {_FEATURES}, p AS (SELECT source_id, CASE WHEN ruwe >= 2.0 THEN 16.0 WHEN ruwe >= 1.4 THEN 9.0 ELSE 0.0 END AS r, CASE WHEN colour <= -0.1 OR colour >= 2.8 THEN 10.5 ELSE 0.0 END AS c, CASE WHEN pm >= 80 THEN 14.0 WHEN pm >= 40 THEN 7.0 ELSE 0.0 END AS m FROM f)
SELECT source_id, round(coalesce(r / nullif(r + c + m, 0), 0), 2) AS ruwe, round(coalesce(c / nullif(r + c + m, 0), 0), 2) AS color, round(coalesce(m / nullif(r + c + m, 0), 0), 2) AS motion FROM p""")
def feature_importance(spark, sf_dir):
    return discovery.feature_importance(stars(spark, sf_dir))


def _robust(seeds) -> str:
    context = "CASE WHEN k > 1 THEN least((k - 1) * {density_scale}, {density_cap}) ELSE 0.0 END + CASE WHEN m > 0 THEN least({cross_match_base} + m * {cross_match_per_catalog}, {cross_match_cap}) ELSE 0.0 END + CASE WHEN catalog <> 'GAIA' THEN least(m * {catalog_overlap_bonus}, {catalog_overlap_cap}) ELSE 0.0 END"
    weights = [perturbed(_P, seed) for seed in seeds]
    scores = ", ".join(f"round(least({_points(p)} + {context.format(**p)}, 100.0), 1)" for p in weights)
    return f"""{W}, {_FEATURES}, {near(0.08)}, n AS (SELECT a_id, count(*) AS k, count(DISTINCT CASE WHEN {_NAMED.format('b_cat')} <> {CATALOG.replace('catalog_source', 'a_cat')} THEN {_NAMED.format('b_cat')} END) AS m FROM pairs WHERE a_id <> b_id GROUP BY a_id),
c AS (SELECT f.*, coalesce(k, 0) AS k, coalesce(m, 0) AS m FROM f LEFT JOIN n ON a_id = source_id), s AS (SELECT source_id, CAST([{scores}] AS DOUBLE[]) AS x FROM c), t AS (SELECT *, list_sum(x) / {len(weights)} AS mean FROM s),
u AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: pow(v - mean, 2))) / {len(weights)}) AS std FROM t)
SELECT source_id, round(mean, 2) AS mean_score, round(std, 3) AS std_dev, CASE WHEN std < 1 THEN 'High' WHEN std < 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM u"""


@query("robust_sweep", _robust((42, 43, 44, 45, 46)))
def robust_sweep(spark, sf_dir):
    return discovery.robust_sweep(stars(spark, sf_dir))


# --- physics ---------------------------------------------------------------------------------------

_TEFF = "CASE WHEN c <= -0.1 THEN 20000.0 WHEN c < 0.2 THEN 9200.0 - 7000.0 * (c + 0.1) / 0.3 WHEN c < 0.6 THEN 7200.0 - 2000.0 * (c - 0.2) / 0.4 WHEN c < 1.2 THEN 5800.0 - 1800.0 * (c - 0.6) / 0.6 WHEN c < 2.1 THEN 4200.0 - 1600.0 * (c - 1.2) / 0.9 WHEN c IS NOT NULL THEN 3000.0 END"
_POP = """CASE WHEN c IS NULL OR m IS NULL THEN 'Unknown' WHEN c < -0.2 THEN CASE WHEN m < 2 THEN 'Blue Supergiant' WHEN m < 5 THEN 'Blue Straggler' ELSE 'Hot Subdwarf' END
 WHEN c < 0.5 THEN CASE WHEN m < 4 THEN 'Main Sequence (O-B)' ELSE 'White Dwarf Candidate' END WHEN c < 1.6 THEN CASE WHEN m < 4 THEN 'Giant/Subgiant' WHEN m < 6 THEN 'Main Sequence (A-F)' ELSE 'Main Sequence (G)' END
 WHEN c < 2.7 THEN CASE WHEN m < 5 THEN 'K Giant' WHEN m < 9 THEN 'Main Sequence (K)' ELSE 'K Dwarf' END ELSE CASE WHEN m < 5 THEN 'M Giant' WHEN m < 10 THEN 'M Dwarf' ELSE 'Brown Dwarf Candidate' END END"""
_MASS = "round(greatest(0.08, least(20.0, pow(10, CASE WHEN c < -0.2 THEN 0.25 * m - 1.5 WHEN c < 0.0 THEN 0.17 * m - 0.9 WHEN c < 0.6 THEN 0.27 * m - 1.3 WHEN c < 1.4 THEN 0.25 * m - 1.0 ELSE 0.2 * m - 0.5 END))), 2)"
_HEUR = "CASE WHEN c <= 0 THEN 1.8 WHEN c <= 0.6 THEN 1.2 WHEN c <= 1.4 THEN 0.95 WHEN c IS NOT NULL THEN 0.75 ELSE 1.0 END"
_CM = f"{W}, q AS (SELECT *, {COLOUR} AS c, {M_G} AS m FROM stars)"


@query("stellar_parameters", f"""{_CM}, p AS (SELECT *, CASE WHEN c IS NOT NULL AND m IS NOT NULL THEN {_MASS} ELSE {_HEUR} END AS mass FROM q)
SELECT source_id, mass AS initial_mass, CASE WHEN mass >= 2.5 THEN 4.0 WHEN mass >= 1.2 THEN 4.3 WHEN mass >= 0.8 THEN 4.4 ELSE 4.6 END AS log_g, round(CASE WHEN c IS NOT NULL AND m IS NOT NULL THEN {_TEFF} ELSE 5778.0 END, 0) AS teff_k, 0.02 AS initial_z,
 round(c, 4) AS bp_rp, round(m, 3) AS abs_mag_g, coalesce({MOTION} > 80, false) AS high_motion, {_POP} AS population FROM p""")
def stellar_parameters(spark, sf_dir):
    p = stars(spark, sf_dir).withColumn("p", stellar.physical_parameters()).withColumn("population", stellar.population14(stellar.bp_rp(), stellar.absolute_mag()))
    return p.select("source_id", "p.initial_mass", "p.log_g", "p.teff_k", "p.initial_z", "p.bp_rp", "p.abs_mag_g", "p.high_motion", "population")


@query("stellar_geometry", f"""{W} SELECT source_id, round(CASE WHEN parallax > 0 THEN 1000 / parallax * cos(radians(dec)) * cos(radians(ra)) END, 6) AS x_pc, round(CASE WHEN parallax > 0 THEN 1000 / parallax * sin(radians(dec)) END, 6) AS y_pc, round(CASE WHEN parallax > 0 THEN 1000 / parallax * cos(radians(dec)) * sin(radians(ra)) END, 6) AS z_pc,
 round(CASE WHEN parallax > 0 THEN 1000 / parallax * 3.26156 END, 6) AS light_years, CASE WHEN ruwe > 1 AND parallax > 0 THEN round((ruwe - 1) * (1000 / parallax) * 0.5, 6) ELSE 0.0 END AS separation_au, upper(nullif(trim(regexp_replace(translate(object_class, '_/', '  '), '\\s+', ' ', 'g')), '')) AS object_class FROM stars""")
def stellar_geometry(spark, sf_dir):
    d = sky.distance_pc("parallax")
    x, y, z = sky.to_cartesian("ra", "dec", d)
    return stars(spark, sf_dir).select("source_id", F.round(x, 6).alias("x_pc"), F.round(y, 6).alias("y_pc"), F.round(z, 6).alias("z_pc"), F.round(sky.light_years(d), 6).alias("light_years"), F.round(stellar.binary_separation(), 6).alias("separation_au"), normalize_object_class("object_class").alias("object_class"))


_FLUX = [(w, f"round({z} * pow(10, -0.4 * {c}), 4)", c) for c, (w, z) in stellar.FILTERS.items() if c.startswith("phot")]
_PEAK = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {{'f': {f}, 'w': {-w}}} END" for w, f, c in _FLUX)


@query("sed_temperature", f"{W}, s AS (SELECT source_id, list_filter([{_PEAK}], lambda x: x IS NOT NULL) AS p FROM stars) SELECT source_id, CAST(len(p) AS INTEGER) AS n_points, round(2898.0 / -(list_reverse_sort(p)[1]).w, 0) AS teff_k FROM s")
def sed_temperature(spark, sf_dir):
    s = stars(spark, sf_dir).withColumn("sed", stellar.sed(["phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"]))
    return s.select("source_id", F.size("sed").alias("n_points"), stellar.wien_teff("sed").alias("teff_k"))
