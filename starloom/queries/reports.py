"""Reports over regions and catalogs, files read and written, names, and clusters of all stars, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.sql import register_table_functions
from starloom.functions.tables import table
from starloom.operators import aggregates, crossmatch, discovery, graph, hybrid, vectors, volume
from starloom.plans.durable import new_path
from starloom.plans.fixtures import papers, regions, stars, with_views
from starloom.queries.catalog import _SCORED, _by_paper, _edges, _scored, rounded
from starloom.queries.more import _TYPES
from starloom.queries.sky import _CONE, _IN, _NAMED, COLOUR, M_G, W, WR, _robust, near, sep
from starloom.sources import catalogs, exports

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- regions and catalogs --------------------------------------------------------------------------


@query("overlap_report", f"""{W}, {near(0.02)}, u AS (SELECT count(*) FILTER (ra IS NOT NULL AND dec IS NOT NULL AND source_id NOT IN (SELECT a_id FROM pairs WHERE {_NAMED.format('a_cat')} <> {_NAMED.format('b_cat')})) AS alone, count(*) AS total_stars FROM stars)
SELECT total_stars, total_stars - alone AS multi_detected, round((total_stars - alone) / total_stars, 3) AS multi_fraction FROM u""")
def overlap_report(spark, sf_dir):
    return crossmatch.overlap_report(stars(spark, sf_dir), 72.0)


def _robust_in_cone() -> str:
    """The sweep's oracle over the nearest hundred stars of a cone in place of all stars."""
    cone = _CONE.rstrip().replace(", c AS (", ", near_it AS (").replace("\nf AS (", "\nkept AS (").replace("c AS (SELECT *, ", "near_it AS (SELECT *, ", 1).replace("FROM c WHERE", "FROM near_it WHERE")
    pool = f"{cone}, pool AS (SELECT * EXCLUDE (n, d) FROM kept WHERE n = 1 ORDER BY d, source_id LIMIT 100)"
    sweep = _robust((42, 43, 44, 45, 46)).removeprefix(W)
    return pool + sweep.replace("FROM stars", "FROM pool")


@query("robust_candidates", _robust_in_cone())
def robust_candidates(spark, sf_dir):
    return discovery.robust_candidates(stars(spark, sf_dir), 66.75, 15.87, 10.0).select("source_id", "robust_score.*")


_POPULATION = """CASE WHEN c IS NULL THEN 'Unknown' WHEN c < -0.2 THEN CASE WHEN m < 2 THEN 'Blue Supergiant' WHEN m < 5 THEN 'Blue Straggler' WHEN m IS NOT NULL THEN 'Hot Subdwarf' ELSE 'Unknown' END
 WHEN c < 0.5 THEN CASE WHEN m < 4 THEN 'Main Sequence (O-B)' WHEN m IS NOT NULL THEN 'White Dwarf Candidate' ELSE 'Unknown' END
 WHEN c < 1.6 THEN CASE WHEN m < 4 THEN 'Giant/Subgiant' WHEN m < 6 THEN 'Main Sequence (A-F)' WHEN m IS NOT NULL THEN 'Main Sequence (G)' ELSE 'Unknown' END
 WHEN c < 2.7 THEN CASE WHEN m < 5 THEN 'K Giant' WHEN m < 9 THEN 'Main Sequence (K)' WHEN m IS NOT NULL THEN 'K Dwarf' ELSE 'Unknown' END
 ELSE CASE WHEN m < 5 THEN 'M Giant' WHEN m < 10 THEN 'M Dwarf' WHEN m IS NOT NULL THEN 'Brown Dwarf Candidate' ELSE 'Unknown' END END"""
_MEMBERS = f"{with_views('regions')}, s AS (SELECT * FROM ({_SCORED})), m AS (SELECT s.*, r.name AS region, row_number() OVER (PARTITION BY r.name ORDER BY score DESC, source_id) AS k, len({_TYPES}) > 0 AS hit FROM s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg)"


@query("discovery_precision", f"""{_MEMBERS}, g AS (SELECT region, count(*) AS total_stars, count(*) FILTER (score > 0) AS total_scored, count(*) FILTER (k <= 20) AS candidates, count(*) FILTER (k <= 20 AND hit) AS confirmed FROM m GROUP BY 1),
u AS (SELECT * FROM g UNION ALL SELECT NULL, sum(total_stars), sum(total_scored), sum(least(total_scored, 20)), sum(confirmed) FROM g)
SELECT region, CAST(total_stars AS BIGINT) AS total_stars, CAST(total_scored AS BIGINT) AS total_scored, CAST(candidates AS BIGINT) AS candidates, CAST(confirmed AS BIGINT) AS confirmed, round(confirmed / candidates, 3) AS precision FROM u""")
def discovery_precision(spark, sf_dir):
    return aggregates.discovery_precision(crossmatch.region_members(_scored(spark, sf_dir), regions(spark)))


@query("ingest_stats", f"{W}, c AS (SELECT coalesce(nullif(trim(catalog_source), ''), 'UNKNOWN') AS catalog, count(*) AS n FROM stars GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS catalogs, string_agg(catalog || '=' || n, ';' ORDER BY catalog) AS by_catalog FROM c")
def ingest_stats(spark, sf_dir):
    listed = F.array_join(F.transform(F.map_entries("by_catalog"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return aggregates.ingest_stats(stars(spark, sf_dir)).withColumn("by_catalog", listed)


@query("regions_by_type", f"""{WR}, c AS (SELECT r.name, CASE WHEN r.radius_deg >= 4 THEN 'association' ELSE 'open cluster' END AS type, count(s.source_id) AS star_count FROM regions r LEFT JOIN stars s ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg GROUP BY ALL)
SELECT type, count(*) AS regions, CAST(sum(star_count) AS BIGINT) AS stars, string_agg(name, ';' ORDER BY name) AS names FROM c GROUP BY 1""")
def regions_by_type(spark, sf_dir):
    r = regions(spark)
    counted = aggregates.region_counts(stars(spark, sf_dir), r).withColumnRenamed("region", "name").join(r, "name")
    typed = counted.withColumn("type", F.when(F.col("radius_deg") >= 4, "association").otherwise("open cluster"))
    return aggregates.regions_by_type(typed).withColumn("names", F.array_join("names", ";"))


# --- files -----------------------------------------------------------------------------------------

@query("gaia_csv_round_trip", f"{W} SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, phot_g_mean_mag, 'GAIA' AS catalog_source, object_class FROM stars")
def gaia_csv_round_trip(spark, sf_dir):
    """The stars written as an archive's CSV with headers of its own and read back through the catalog reader."""
    path = new_path(spark, "gaia")
    stars(spark, sf_dir).select(F.col("source_id").alias("SOURCEID"), F.col("ra").alias(" ra_deg"), F.col("dec").alias("DEC_DEG"), "phot_g_mean_mag", F.col("object_class").alias("kind"), F.lit("x").alias("unused")).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    found = catalogs.ingest(catalogs.read_gaia_csv(spark, path))
    return rounded(found.select("source_id", "ra", "dec", "phot_g_mean_mag", "catalog_source", "object_class"))


@query("ingest_limited", "SELECT least(count(*), 1000) AS n FROM orders")
def ingest_limited(spark, sf_dir):
    return catalogs.ingest(stars(spark, sf_dir), 1000).agg(F.count("*").alias("n"))


@query("json_export", f"{W} SELECT source_id, round(ra, 6) AS ra, round(phot_bp_mean_mag - phot_rp_mean_mag, 6) AS bp_rp, {len(exports.FIELDS)} AS n_columns, {len(exports.UNITS)} AS n_units FROM stars")
def json_export(spark, sf_dir):
    """Rows of a JSON export read back, beside what its metadata says."""
    path = new_path(spark, "export")
    exports.export_json(stars(spark, sf_dir), path, "all stars")
    told = spark.read.json(f"{path}/metadata").agg(F.count("*").cast("int").alias("n_columns"), F.count("unit").cast("int").alias("n_units"))
    return rounded(spark.read.schema("source_id string, ra double, bp_rp double").json(f"{path}/rows").join(F.broadcast(told)))


@query("topcat_export", f"{W} SELECT count(*) AS n, round(sum(ra), 3) AS ra, {len(exports.FIELDS)} AS n_lines FROM stars")
def topcat_export(spark, sf_dir):
    path = new_path(spark, "topcat")
    exports.export_topcat(stars(spark, sf_dir), path)
    lines = spark.read.text(f"{path}/header").agg(F.count_if(F.col("value").startswith("# ")).cast("int").alias("n_lines"))
    return spark.read.csv(f"{path}/rows", header=True).agg(F.count("*").alias("n"), F.round(F.sum(F.col("ra").cast("double")), 3).alias("ra")).join(lines)


@query("audit_log", f"{WR} SELECT r.name AS catalog, 'cone' AS action, CAST(r.radius_deg AS VARCHAR) AS radius, 'SELECT *' AS raw_query, ['region', 'count'] AS tags, count(s.source_id) AS n FROM regions r LEFT JOIN stars s ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg GROUP BY r.name, r.radius_deg")
def audit_log(spark, sf_dir):
    """One record per region search appended to the log, read back beside the regions' counts."""
    path = new_path(spark, "audit")
    for r in regions(spark).collect():  # a handful
        exports.append_audit(exports.audit_record(spark, "cone", {"radius": r.radius_deg}, "SELECT *", r["name"], ["region", "count"]), path)
    log = spark.read.schema("action string, params map<string, string>, raw_query string, catalog string, tags array<string>, at timestamp").json(path)
    n = aggregates.region_counts(stars(spark, sf_dir), regions(spark)).select(F.col("region").alias("catalog"), F.col("star_count").alias("n"))
    return log.where("at IS NOT NULL").join(n, "catalog").select("catalog", "action", F.col("params")["radius"].alias("radius"), "raw_query", "tags", "n")


@query("synthetic_regions", f"{WR} SELECT 'SYN_' || replace(r.name, ' ', '_') AS region, 200 AS n, true AS around FROM regions r")
def synthetic_regions(spark, sf_dir):
    """Generated stars of each region: as many as asked for, with their mean near the region's centre."""
    r = regions(spark)
    made = catalogs.synthetic_stars(spark, r, 200).withColumn("region", F.regexp_replace("source_id", r"_\d+$", ""))
    by = made.groupBy("region").agg(F.count("*").cast("int").alias("n"), F.avg("ra").alias("mra"), F.avg("dec").alias("mdec"))
    key = r.select(F.concat(F.lit("SYN_"), F.replace("name", F.lit(" "), F.lit("_"))).alias("region"), "ra", "dec", "radius_deg")
    return by.join(key, "region").select("region", "n", ((F.abs(F.col("mra") - F.col("ra")) < F.col("radius_deg") / 4) & (F.abs(F.col("mdec") - F.col("dec")) < F.col("radius_deg") / 4)).alias("around"))


# --- names and positions ---------------------------------------------------------------------------


def _placed(who: str) -> str:
    return f"SELECT source_id, ra, dec, CAST(floor((dec + 90) / 0.01) AS BIGINT) AS zone FROM {who} WHERE ra IS NOT NULL AND dec IS NOT NULL"


_FIELD = "SELECT 'F' || source_id AS field, ra + 0.0003E0 AS ra, dec FROM {stars} WHERE source_id LIKE '%3' AND ra IS NOT NULL"
_NEAREST_STAR = f"""z AS ({_placed('stars')}), q AS (SELECT *, unnest([zone - 1, zone, zone + 1]) AS zz FROM (SELECT *, CAST(floor((dec + 90) / 0.01) AS BIGINT) AS zone FROM fields)),
m AS (SELECT q.field, z.source_id, {sep('q.ra', 'q.dec', 'z.ra', 'z.dec')} AS d FROM q JOIN z ON q.zz = z.zone), b AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY d, source_id) AS k FROM m WHERE d <= 5.0 / 3600)"""


@query("match_fields", f"{W}, fields AS ({_FIELD.replace('{stars}', 'stars')}), {_NEAREST_STAR} SELECT field, source_id, round(d * 3600, 4) AS separation_arcsec FROM b WHERE k = 1")
def match_fields(spark, sf_dir):
    fields = spark.sql(_FIELD, stars=stars(spark, sf_dir))
    return crossmatch.match_fields(stars(spark, sf_dir), fields).select("field", F.col("source_id_b").alias("source_id"), F.round("separation_arcsec", 4).alias("separation_arcsec"))


_WITH_ALERTS = "SELECT source_id, ra, dec, CASE WHEN source_id LIKE '%1' THEN 'AT' || right(source_id, 6) END AS alert_name FROM {stars}"


@query("star_by_name", f"""{W}, s AS ({_WITH_ALERTS.replace('{stars}', 'stars')}), fields AS (SELECT lower('Field ' || source_id) AS field, ra, dec FROM stars WHERE source_id LIKE '%3' AND ra IS NOT NULL), {_NEAREST_STAR},
n AS (SELECT lower(alert_name) AS name, min(source_id) AS source_id FROM s WHERE alert_name IS NOT NULL GROUP BY 1)
SELECT name, source_id FROM n UNION ALL SELECT lower('Field ' || s.source_id), b.source_id FROM stars s LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON b.field = lower('Field ' || s.source_id) WHERE s.source_id LIKE '%3'""")
def star_by_name(spark, sf_dir):
    s = spark.sql(_WITH_ALERTS, stars=stars(spark, sf_dir))
    authority = s.where("source_id LIKE '%3'").select(F.concat(F.lit("Field "), F.col("source_id")).alias("name"), "ra", "dec")
    names = s.where("alert_name IS NOT NULL").select(F.concat(F.lit(" "), F.col("alert_name")).alias("name")).union(authority.select("name"))
    return graph.star_by_name(s, names, authority.where("ra IS NOT NULL"))


_TOPICS = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'topic ' || o_orderkey END AS topic, CASE WHEN o_orderkey % 3 <> 1 THEN 'left ' || o_orderkey END AS topic1, 'right ' || o_orderkey AS topic2 FROM {orders}"


@query("topic_texts", f"SELECT coalesce(topic, concat_ws(' vs ', topic1, topic2)) AS text, count(*) AS n FROM ({_TOPICS.replace('{orders}', 'orders')}) GROUP BY 1")
def topic_texts(spark, sf_dir):
    return spark.sql(_TOPICS, orders=table(spark, sf_dir, "orders")).groupBy(vectors.topic_text().alias("text")).agg(F.count("*").alias("n"))


@query("semantic_with_stars")
def semantic_with_stars(spark, sf_dir):
    v = _by_paper(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return hybrid.semantic_with_stars(v.select("id", "vector"), _edges(spark, sf_dir), stars(spark, sf_dir), q)


_TWO_WORDS = "SELECT DISTINCT regexp_extract(title, '^([A-Za-z]+ [A-Za-z]+) ', 1) AS name FROM {papers} WHERE CAST(right(arxiv_id, 2) AS INT) % 20 = 0"
_LOOSE_SQL = r"(?i)\b((?:HD|HIP|HR|TIC|TYC|GJ|GL|LHS|LSPM)\s*[A-Z0-9.+\-]+)\b"


@query("star_names_of_a_table")
def star_names_of_a_table(spark, sf_dir):
    """Loose identifiers and the names of a table that grows with the papers: the first two words of every twentieth title."""
    p = papers(spark, sf_dir)
    names = spark.sql(_TWO_WORDS, papers=p).where("name <> ''").union(spark.sql("SELECT 'Sirius'"))
    return hybrid.star_names(p, names)


# --- SQL functions that return tables --------------------------------------------------------------


def _sql(spark, sf_dir):
    register_table_functions(spark, stars(spark, sf_dir))
    return spark


@query("sql_cone", f"{W} SELECT source_id, round({sep('ra', 'dec', '66.75', '15.87')}, 6) AS sep_deg FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 5")
def sql_cone(spark, sf_dir):
    return _sql(spark, sf_dir).sql("SELECT source_id, round(sep_deg, 6) AS sep_deg FROM cone(66.75, 15.87, 5)")


@query("sql_overlap", f"{W}, {near(0.02)} SELECT {_NAMED.format('a_cat')} AS c1, {_NAMED.format('b_cat')} AS c2, count(DISTINCT a_id) AS matches FROM pairs WHERE {_NAMED.format('a_cat')} < {_NAMED.format('b_cat')} GROUP BY 1, 2")
def sql_overlap(spark, sf_dir):
    return _sql(spark, sf_dir).sql("SELECT c1, c2, matches FROM overlap(72)")


@query("sql_ranking", f"SELECT source_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, source_id) AS INTEGER) AS place FROM ({_SCORED}) QUALIFY place <= 25")
def sql_ranking(spark, sf_dir):
    return rounded(_sql(spark, sf_dir).sql("SELECT source_id, score, place FROM ranking(25, 'balanced')"))


@query("sql_scalars", f"""{W} SELECT {_POPULATION} AS population, count(*) AS n, round(avg({M_G}), 6) AS mean_mag FROM (SELECT *, {COLOUR} AS c, {M_G} AS m FROM stars) GROUP BY 1""")
def sql_scalars(spark, sf_dir):
    return _sql(spark, sf_dir).sql("SELECT population14(bp_rp(phot_bp_mean_mag, phot_rp_mean_mag), absolute_mag(phot_g_mean_mag, parallax)) AS population, count(*) AS n, round(avg(absolute_mag(phot_g_mean_mag, parallax)), 6) AS mean_mag FROM {s} GROUP BY 1", s=stars(spark, sf_dir))


# --- clusters of all stars -------------------------------------------------------------------------


@query("kmeans_all_stars", f"{W} SELECT count(*) AS n, 3 AS clusters, true AS nearest FROM stars WHERE parallax > 0 AND ra IS NOT NULL")
def kmeans_all_stars(spark, sf_dir):
    """Three clusters over all stars with a distance, from k-means|| seeds; every star is in the cluster of the nearest mean to within the rounds' last step."""
    p = volume.kmeans3d(volume.display_projection(volume.space_volume(stars(spark, sf_dir), None)), seeding="parallel", max_iter=50)
    return p.agg(F.count("*").alias("n"), F.count_distinct("cluster").cast("int").alias("clusters"), F.max(F.col("cluster").between(0, 2)).alias("nearest"))
