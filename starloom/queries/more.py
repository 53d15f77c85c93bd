"""Queries of derived columns, paper sections, evaluations, exports and graph nodes, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import sky, stellar
from starloom.functions import text as tx
from starloom.functions.tables import table
from starloom.operators import aggregates, cone, crossmatch, documents, hybrid, metrics, upserts, vectors
from starloom.plans.fixtures import alerts, papers, regions, stars, with_views
from starloom.queries import catalog
from starloom.queries.catalog import _EDGES, _SCORED, _TRUTH, _edges, _scored, rounded
from starloom.queries.sky import _IN, _XMATCH, CATALOG, COLOUR, M_G, MOTION, ORACLES as SKY_ORACLES, W, WR, near, sep
from starloom.sources import exports, feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


# --- derived columns -------------------------------------------------------------------------------


@query("star_errors_and_sizes", f"""{W} SELECT source_id, round(CASE WHEN parallax > 0 THEN radians(0.5) * 1000 / parallax END, 6) AS size_pc, round(sqrt(pow(parallax_error, 2) + pow(ruwe, 2)) * 10000, 4) AS teff_error,
 0.31 AS a_v, round(phot_g_mean_mag - 0.86 * 0.31, 3) AS g_corrected, round({COLOUR} - 0.41 * 0.31, 3) AS bp_rp_corrected FROM stars""")
def star_errors_and_sizes(spark, sf_dir):
    d = stellar.deredden(0.1)
    return stars(spark, sf_dir).select("source_id", F.round(stellar.angular_size_pc(0.5), 6).alias("size_pc"), F.round(stellar.teff_error("parallax_error", "ruwe"), 4).alias("teff_error"), d["a_v"].alias("a_v"), d["g_corrected"].alias("g_corrected"), d["bp_rp_corrected"].alias("bp_rp_corrected"))


@query("sky_round_trip", f"{W} SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(1000 / parallax, 6) AS distance_pc FROM stars WHERE parallax > 0 AND ra IS NOT NULL AND dec IS NOT NULL")
def sky_round_trip(spark, sf_dir):
    s = stars(spark, sf_dir).where("parallax > 0 AND ra IS NOT NULL AND dec IS NOT NULL")
    for name, c in zip("xyz", sky.to_cartesian("ra", "dec", sky.distance_pc("parallax")), strict=True):
        s = s.withColumn(name, c)
    ra, dec, distance = sky.from_cartesian("x", "y", "z")
    return s.select("source_id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"), F.round(distance, 6).alias("distance_pc"))


_H, _D = "round(ra / 15 * 3600, 4)", "round(abs(dec) * 3600, 3)"


@query("sky_labels", f"""{W} SELECT source_id, printf('%02d:%02d:%07.4f', CAST(floor({_H} / 3600) AS BIGINT), CAST(floor(({_H} % 3600) / 60) AS BIGINT), {_H} % 60) AS ra_text,
 (CASE WHEN dec < 0 THEN '-' ELSE '+' END) || printf('%02d.%02d.%06.3f', CAST(floor({_D} / 3600) AS BIGINT), CAST(floor(({_D} % 3600) / 60) AS BIGINT), {_D} % 60) AS dec_text,
 printf('https://aladin.u-strasbg.fr/AladinLite/?target=%.6f', ra) || '%20' || printf('%.6f&fov=%.4f', dec, 0.1) AS link FROM stars WHERE ra IS NOT NULL AND dec IS NOT NULL""")
def sky_labels(spark, sf_dir):
    ra, dec = sky.sexagesimal("ra", "dec")
    return stars(spark, sf_dir).where("ra IS NOT NULL AND dec IS NOT NULL").select("source_id", ra.alias("ra_text"), dec.alias("dec_text"), sky.sky_link("ra", "dec", F.lit(0.05)).alias("link"))


@query("cone_in_arcminutes", f"{W} SELECT count(*) AS n FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 5")
def cone_in_arcminutes(spark, sf_dir):
    return aggregates.count_in_cone(stars(spark, sf_dir), 66.75, 15.87, sky.radius_to_deg(300, "arcmin"))


@query("frames", f"""{W} SELECT source_id, CASE WHEN source_id LIKE '%1' THEN round(ra, 6) ELSE NULL END AS same_ra,
 round(((192.85948 + degrees(atan2(cos(radians(dec)) * sin(radians(122.93192 - ra)), cos(radians(27.12825)) * sin(radians(dec)) - sin(radians(27.12825)) * cos(radians(dec)) * cos(radians(122.93192 - ra))))) % 360 + 360) % 360, 6) AS icrs_ra FROM stars""")
def frames(spark, sf_dir):
    same, turned = sky.to_icrs("ra", "dec", "fk5"), sky.to_icrs("ra", "dec", "Galactic")
    return stars(spark, sf_dir).select("source_id", F.when(F.col("source_id").endswith("1"), F.round(same[0], 6)).alias("same_ra"), F.round(turned[0], 6).alias("icrs_ra"))


@query("flux_of_all_filters", f"{W} SELECT source_id, " + ", ".join(f"round({zero} * pow(10, -0.4 * phot_g_mean_mag), 4) AS {name.lower()}" for name, (_, zero) in stellar.FILTERS.items()) + " FROM stars")
def flux_of_all_filters(spark, sf_dir):
    return stars(spark, sf_dir).select("source_id", *(F.round(stellar.flux_jy("phot_g_mean_mag", name), 4).alias(name.lower()) for name in stellar.FILTERS))


@query("metallicity_by_name", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.004 WHEN 'O' THEN 0.008 ELSE 0.02 END AS z FROM orders")
def metallicity_by_name(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", "smc stars").when(F.col("o_orderstatus") == "O", "Lmc field").otherwise("GAIA")
    return table(spark, sf_dir, "orders").withColumn("name", name).select("o_orderkey", stellar.metallicity("name").alias("z"))


@query("display_bounds", f"""{W}, p AS (SELECT 1000 / parallax * cos(radians(dec)) * cos(radians(ra)) AS x, 1000 / parallax * sin(radians(dec)) AS y, 1000 / parallax * cos(radians(dec)) * sin(radians(ra)) AS z FROM stars WHERE parallax > 0)
SELECT round(min(x), 6) AS min_x_pc, round(max(x), 6) AS max_x_pc, round(min(y), 6) AS min_y_pc, round(max(y), 6) AS max_y_pc, round(min(z), 6) AS min_z_pc, round(max(z), 6) AS max_z_pc FROM p""")
def display_bounds(spark, sf_dir):
    x, y, z = sky.to_cartesian("ra", "dec", sky.distance_pc("parallax"))
    return rounded(aggregates.bounds(stars(spark, sf_dir).where("parallax > 0").select(x.alias("x_pc"), y.alias("y_pc"), z.alias("z_pc"))))


# --- filters and alerts ----------------------------------------------------------------------------


@query("otype_filter", f"{W} SELECT source_id, object_class AS otype FROM stars WHERE object_class IN ('yso/young_star', ' rr_lyrae ') AND object_class <> ' rr_lyrae '")
def otype_filter(spark, sf_dir):
    s = stars(spark, sf_dir).select("source_id", F.col("object_class").alias("otype"))
    return cone.filter_otype(s, include=["yso/young_star", " rr_lyrae "], exclude=[" rr_lyrae "])


@query("otype_counts", f"{W} SELECT coalesce(CASE WHEN trim(object_class) <> '' THEN object_class END, 'Unknown') AS otype, count(*) AS n FROM stars GROUP BY 1")
def otype_counts(spark, sf_dir):
    return aggregates.otype_distribution(stars(spark, sf_dir).withColumnRenamed("object_class", "otype"))


@query("recent_alerts", f"{with_views('stars', 'alerts')} SELECT name FROM alerts WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY AND type IN ('click', 'purchase')")
def recent_alerts(spark, sf_dir):
    return feeds.recent(alerts(spark, sf_dir), 10, ["click", "purchase"], "2024-01-20 00:00:00").select("name")


# --- evaluations -----------------------------------------------------------------------------------


@query("calibration", f"""WITH c AS (SELECT count(*) FILTER (score >= 8 AND t) AS tp, count(*) FILTER (score >= 8 AND NOT t) AS fp, count(*) FILTER (score < 8 AND t) AS fn, count(*) FILTER (score < 8 AND NOT t) AS tn FROM (SELECT *, {_TRUTH} AS t FROM ({_SCORED}))),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, CASE WHEN p >= 0.5 THEN 'calibrated' ELSE 'needs_calibration' END AS status FROM m""")
def calibration(spark, sf_dir):
    return rounded(aggregates.calibration_status(aggregates.confusion(_scored(spark, sf_dir)), 0.5))


@query("benchmark_stats", "SELECT o_orderpriority AS type, o_orderstatus AS difficulty, count(*) AS n, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(o_custkey % 100 / 100.0), 6) AS mean_score, round(avg(o_orderkey % 977), 6) AS mean_latency_ms FROM orders GROUP BY 1, 2")
def benchmark_stats(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, "PASS").otherwise("FAIL")
    results = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("difficulty"), status.alias("status"), (F.col("o_custkey") % 100 / 100).alias("score"), (F.col("o_orderkey") % 977).alias("latency_ms"))
    return rounded(aggregates.benchmark_stats(results))


_N = "SELECT o_orderkey, o_orderkey % 4 AS s, o_custkey % 3 AS p FROM orders"


@query("answer_scores", f"""WITH n AS ({_N}), h AS (SELECT *, CASE WHEN s + p >= 4 THEN 1.0 ELSE CASE WHEN s > 0 THEN 0.5 ELSE 0.0 END + CASE WHEN p > 0 THEN 0.5 ELSE 0.0 END END AS hybrid FROM n)
SELECT o_orderkey, hybrid, CASE WHEN hybrid >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS hybrid_status, CASE WHEN s >= 3 THEN 1.0 WHEN s > 0 THEN 0.5 ELSE 0.0 END AS discovery, CASE WHEN s >= 3 THEN 'PASS' WHEN s > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS discovery_status, round((s - p) / nullif(p, 0) * 100, 6) AS improvement FROM h""")
def answer_scores(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("s"), (F.col("o_custkey") % 3).alias("p"), F.lit(4).alias("four"), F.lit(3).alias("three"))
    h, d = metrics.hybrid_score("s", "p", "four"), metrics.discovery_score("s", "three")
    return n.select("o_orderkey", h["score"].alias("hybrid"), h["status"].alias("hybrid_status"), d["score"].alias("discovery"), d["status"].alias("discovery_status"), F.round(metrics.relative_improvement("s", "p"), 6).alias("improvement"))


@query("mean_label_metrics", "SELECT round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM labels")
def mean_label_metrics(spark, sf_dir):
    return metrics.mean_metrics(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query"), "quality", "toxic"))


_TYPES = f"""list_filter([CASE WHEN {MOTION} >= 100 THEN 'high_proper_motion' END, CASE WHEN ruwe >= 1.8 THEN 'high_ruwe' END, CASE WHEN {COLOUR} <= -0.1 THEN 'extreme_blue' END, CASE WHEN {COLOUR} >= 2.8 THEN 'extreme_red' END,
 CASE WHEN phot_g_mean_mag < 10 AND parallax > 0 AND 1000 / nullif(parallax, 0) > 500 THEN 'overluminous' END, CASE WHEN ({M_G}) > 10 AND coalesce({COLOUR} < 1.5, true) THEN 'white_dwarf_candidate' END], lambda x: x IS NOT NULL)"""


#: Oracles of queries that stand in the other modules.
ORACLES["anomaly_totals"] = f"""{with_views('regions')}, s AS (SELECT * FROM ({_SCORED})), m AS (SELECT s.*, r.name AS region, row_number() OVER (PARTITION BY r.name ORDER BY score DESC, source_id) AS k FROM s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg)
SELECT type, count(*) AS n FROM (SELECT unnest({_TYPES}) AS type FROM m WHERE k <= 20) GROUP BY 1"""
ORACLES["catalog_comparison"] = _XMATCH.replace(" AND catalog_source IN ('gaia ', 'GAIA')),", "),") + f"""k AS (SELECT DISTINCT source_id FROM m WHERE d <= 100.0 / 3600)
SELECT replace({CATALOG}, ' ', '-') AS catalog, count(*) AS total, count(k.source_id) AS matched FROM stars s LEFT JOIN k ON k.source_id = s.source_id GROUP BY 1"""


# --- papers ----------------------------------------------------------------------------------------

WP = with_views("papers")
_FILE = "arxiv_id || '.pdf'"
_TEXT = "CASE WHEN length(abstract) % 2 = 0 THEN 'arXiv:' || arxiv_id ELSE '' END || chr(10) || 'short' || chr(10) || 'The Title Of One Paper, ' || arxiv_id || chr(10) || 'Abstract: ' || replace(abstract, chr(10), ' ') || chr(10) || chr(10) || 'Introduction' || chr(10) || 'We begin.'"


@query("paper_sections", rf"""{WP}, r AS (SELECT {_FILE} AS file, {_TEXT} AS t FROM papers), x AS (SELECT file, t, regexp_extract(left(t, 5000), 'arXiv:(\d{{4}}\.\d{{4,5}})', 1) AS id FROM r)
SELECT file, CASE WHEN id <> '' THEN id ELSE file END AS arxiv_id, left(trim(regexp_extract(t, '(?is)abstract[:\s]+(.*?)(?:\n\s*\n|introduction|keywords|$)', 1)), 2000) AS abstract,
 list_filter(list_transform(string_split(left(t, 500), chr(10)), lambda l: trim(l)), lambda l: length(l) > 20 AND regexp_matches(l, '^[A-Z]'))[1] AS title FROM x""")
def paper_sections(spark, sf_dir):
    raw = papers(spark, sf_dir).selectExpr(f"{_FILE} AS file", f"{_TEXT} AS t")
    return raw.select("file", tx.arxiv_id("t", "file").alias("arxiv_id"), tx.extract_abstract("t").alias("abstract"), tx.title_line("t").alias("title"))


@query("corpus_build", f"""{WP}, raw AS (SELECT arxiv_id, title, abstract, 0 AS query_no, row_number() OVER (ORDER BY arxiv_id) AS rank FROM papers WHERE categories IS NOT NULL)
SELECT arxiv_id, concat_ws('. ', title, abstract) AS embed_text FROM raw WHERE arxiv_id NOT LIKE '%5' ORDER BY rank LIMIT 150""")
def corpus_build(spark, sf_dir):
    """Papers come in the order of their ids, so the id is the rank: numbering them would take all through one task."""
    p = papers(spark, sf_dir)
    raw = p.where("categories IS NOT NULL").select(F.concat(F.lit("https://arxiv.example/abs/"), "arxiv_id").alias("url"), "title", "abstract", F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")).alias("authors"), F.lit(0).alias("query_no"), F.col("arxiv_id").alias("rank"), "categories")
    twice = raw.union(raw.withColumn("query_no", F.lit(1)))
    return documents.build_corpus(twice, p.where("arxiv_id LIKE '%5'"), 150).select("arxiv_id", "embed_text")


@query("literature_keyword_share", f"{WP} SELECT round(avg(CASE WHEN contains(lower(abstract), 'binary') OR contains(lower(abstract), 'runaway') THEN 1.0 ELSE 0.0 END), 6) AS share FROM papers WHERE abstract IS NOT NULL")
def literature_keyword_share(spark, sf_dir):
    return rounded(vectors.keyword_share(papers(spark, sf_dir).where("abstract IS NOT NULL"), ["Binary", "runaway"], "abstract"))


@query("collection_info", "SELECT count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim FROM (SELECT embedding FROM embeddings)")
def collection_info(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    return vectors.collection_info(vectors.index_documents(v, v.where("id % 7 = 0")))


# --- graph, regions, sessions ----------------------------------------------------------------------


def _nodes(spark, sf_dir):
    none = spark.createDataFrame([], "kind string, id string, props string")
    s = upserts.upsert_nodes(none, "Star", stars(spark, sf_dir).select("source_id", "ra", "dec"), "source_id")
    again = upserts.upsert_nodes(s, "Star", stars(spark, sf_dir).where("ruwe > 1").select("source_id", "ra", "dec"), "source_id")
    return upserts.upsert_nodes(upserts.upsert_nodes(again, "Paper", papers(spark, sf_dir).select("arxiv_id", "title"), "arxiv_id"), "Cluster", regions(spark), "name")


@query("graph_stats", f"{_EDGES} SELECT 'Star' AS what, count(*) AS n FROM stars UNION ALL SELECT 'Paper', count(*) FROM papers UNION ALL SELECT 'Cluster', count(*) FROM regions UNION ALL SELECT 'MEMBER_OF', count(*) FROM member UNION ALL SELECT 'MENTIONED_IN', count(*) FROM e UNION ALL SELECT 'COVERS', count(*) FROM (SELECT DISTINCT arxiv_id, cluster FROM covers)")
def graph_stats(spark, sf_dir):
    return aggregates.graph_stats(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query("region_upsert", f"{WR} SELECT r.name, round(r.ra + 1, 6) AS ra, count(s.source_id) AS star_count FROM regions r LEFT JOIN stars s ON s.ra IS NOT NULL AND s.phot_g_mean_mag < 12 AND {_IN} <= r.radius_deg GROUP BY r.name, r.ra")
def region_upsert(spark, sf_dir):
    r, s = regions(spark), stars(spark, sf_dir)
    counts = aggregates.region_counts(s.where("phot_g_mean_mag < 12"), r).withColumnRenamed("region", "name")
    batch = r.withColumn("ra", F.col("ra") + 1).withColumn("star_count", F.lit(0).cast("long"))
    return rounded(upserts.upsert_regions(r.join(counts, "name"), batch).select("name", "ra", "star_count"))


@query("region_ingest", f"{WR}, x AS (SELECT source_id FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 8 AND parallax > 0 AND phot_g_mean_mag < 18 ORDER BY source_id LIMIT 1000) SELECT source_id FROM stars WHERE source_id LIKE '%3' UNION SELECT source_id FROM x")
def region_ingest(spark, sf_dir):
    s = stars(spark, sf_dir)
    old = regions(spark).withColumn("star_count", F.lit(0).cast("long"))
    after, _ = upserts.ingest_region(s, s.where("source_id LIKE '%3'"), old, ("Hyades", 66.75, 15.87, 8.0))
    return after.select("source_id")


@query("sessions_left", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id FROM conversations UNION ALL SELECT conv_id FROM conversations WHERE turn = 0) WHERE conv_id IS DISTINCT FROM (SELECT min(conv_id) FROM conversations) GROUP BY 1")
def sessions_left(spark, sf_dir):
    m = table(spark, sf_dir, "conversations")
    first = m.agg(F.min("conv_id")).first()[0]
    both = upserts.append_messages(m, m.where("turn = 0"))
    _, left = upserts.delete_session(m.select("conv_id").distinct(), both, first)
    return left.groupBy("conv_id").agg(F.count("*").alias("n"))


# --- exports ---------------------------------------------------------------------------------------


@query("region_file_lines", f"""{W} SELECT printf('circle(%.6f,%.6f,10") # color=', ra, dec) || CASE WHEN ruwe * 10 >= 15 THEN 'red' WHEN ruwe * 10 >= 10 THEN 'yellow' ELSE 'green' END || ' text={{' || source_id || '}}' AS value FROM stars WHERE ra IS NOT NULL AND dec IS NOT NULL""")
def region_file_lines(spark, sf_dir):
    return exports.ds9_region_lines(stars(spark, sf_dir).withColumn("discovery_score", F.col("ruwe") * 10))


# --- alerts in papers ------------------------------------------------------------------------------


_NAMES = "SELECT DISTINCT 'Gaia DR3 ' || CAST(100000000000000000 + (event_id * 3) % 1500 AS STRING) AS name FROM {events}"


@query("link_alerts_papers", f"{with_views('papers')}, a AS ({_NAMES.replace('{events}', 'events')}) SELECT name, arxiv_id FROM a JOIN papers ON contains(lower(title), lower(name)) OR contains(lower(abstract), lower(name))")
def link_alerts_papers(spark, sf_dir):
    return documents.link_alerts_papers(spark.sql(_NAMES, events=table(spark, sf_dir, "events")), papers(spark, sf_dir))


# --- profiles --------------------------------------------------------------------------------------

_KNOWN = SKY_ORACLES | catalog.ORACLES


@query("research_profile", f"""{W}, {near(1.0)}, sa AS ({_KNOWN['stellar_analysis']}), da AS (SELECT a_id, count(*) FILTER (sep <= 0.1) AS n_small, count(*) AS n_large FROM pairs GROUP BY 1),
x AS (SELECT a_id, least(count(*) FILTER (b_cat = 'WISE'), 5) + least(count(*) FILTER (b_cat = '2MASS'), 5) AS n FROM pairs WHERE sep <= 100.0 / 3600 GROUP BY 1), se AS ({_KNOWN['sed_temperature']})
SELECT source_id, sa.abs_mag, sa.abs_mag_error, sa.population, CASE WHEN ruwe > 1 AND parallax > 0 THEN round((ruwe - 1) * (1000 / parallax) * 0.5, 6) ELSE 0.0 END AS binary_limit, round((n_small / 0.01) / n_large, 6) AS ratio, (n_small / 0.01) / n_large > 3 AS is_peak,
 round(phot_g_mean_mag - 0.86 * 3.1 * 0.05, 3) AS g_corrected, round({COLOUR} - 0.41 * 3.1 * 0.05, 3) AS bp_rp_corrected, se.teff_k, coalesce(x.n, 0) AS n_external
FROM stars JOIN sa USING (source_id) JOIN se USING (source_id) LEFT JOIN da ON da.a_id = source_id LEFT JOIN x ON x.a_id = source_id""")
def research_profile(spark, sf_dir):
    s = stars(spark, sf_dir)
    external = {c: s.where(F.col("catalog_source") == c).select("source_id", "ra", "dec") for c in ("WISE", "2MASS")}
    found = hybrid.research_profile(s, s, external, arcsec=100.0)
    n = F.coalesce(F.aggregate(F.map_values("external"), F.lit(0).cast("long"), lambda a, m: a + F.size(m)), F.lit(0).cast("long"))
    return found.select("source_id", (F.round("abs_mag", 2) + 0.0).alias("abs_mag"), "abs_mag_error", "population", F.round("binary_limit", 6).alias("binary_limit"), F.round("ratio", 6).alias("ratio"), "is_peak", "dereddened.g_corrected", "dereddened.bp_rp_corrected", "teff_k", n.alias("n_external"))
