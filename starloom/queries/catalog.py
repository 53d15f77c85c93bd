"""Queries of summaries, text, graph, vectors, hybrids, metrics, sessions and upserts, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import stellar
from starloom.functions import text as tx
from starloom.functions.columns import normalize_catalog, prefix_source_id, uuid5_dns
from starloom.functions.sky import galactic_to_icrs, mjd
from starloom.functions.tables import table
from starloom.operators import aggregates, crossmatch, discovery, documents, graph, graph_store, hybrid, ivf, metrics, sessions, upserts, vectors, volume
from starloom.operators.profiles import profile
from starloom.plans.durable import new_path
from starloom.plans.fixtures import alerts, messages, papers, regions, stars, with_views
from starloom.queries.sky import _BASE, _CM, _CONE, _IN, _POP, CATALOG, COLOUR, M_G, MOTION, W, WR, near, sep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df, places: int = 6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- summaries -------------------------------------------------------------------------------------


@query("catalog_summary", f"{W} SELECT coalesce(nullif(trim(catalog_source), ''), 'UNKNOWN') AS catalog, count(*) AS n FROM stars GROUP BY 1")
def catalog_summary(spark, sf_dir):
    return aggregates.catalog_summary(stars(spark, sf_dir))


@query("coverage", f"{W} SELECT count(*) AS n, round(min(ra), 2) AS min_ra, round(max(ra), 2) AS max_ra, round(min(dec), 2) AS min_dec, round(max(dec), 2) AS max_dec, round((round(min(ra), 2) + round(max(ra), 2)) / 2, 2) AS centre_ra, round((round(min(dec), 2) + round(max(dec), 2)) / 2, 2) AS centre_dec FROM stars")
def coverage(spark, sf_dir):
    return aggregates.coverage(stars(spark, sf_dir))


@query("cone_density", f"{W} SELECT count(*) AS n, round(least(count(*), 1000) / (pi() * 9), 6) AS density FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 3")
def cone_density(spark, sf_dir):
    return rounded(aggregates.density(stars(spark, sf_dir), 66.75, 15.87, 3.0))


@query("density_anomaly", f"{W}, {near(1.0)}, d AS (SELECT a_id AS source_id, count(*) FILTER (sep <= 0.1) AS n_small, count(*) AS n_large FROM pairs GROUP BY 1) SELECT *, round((n_small / 0.01) / (n_large / 1.0), 6) AS ratio, (n_small / 0.01) / (n_large / 1.0) > 3 AS is_peak FROM d")
def density_anomaly(spark, sf_dir):
    return rounded(aggregates.density_anomaly(stars(spark, sf_dir)))


@query("region_counts", f"{WR} SELECT r.name AS region, count(s.source_id) AS star_count FROM regions r LEFT JOIN stars s ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg GROUP BY 1")
def region_counts(spark, sf_dir):
    return aggregates.region_counts(stars(spark, sf_dir), regions(spark))


@query("compare_regions", f"{WR}, m AS (SELECT r.name AS region, r.radius_deg, s.*, {COLOUR} AS c, sqrt(pmra * pmra + pmdec * pmdec) AS pm FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg WHERE r.name IN ('Hyades', 'Praesepe')) SELECT region, count(*) AS n, round(avg(phot_g_mean_mag), 6) AS mean_g, round(avg(c), 6) AS mean_bp_rp, round(avg(pm), 6) AS mean_pm, round(count(*) / (pi() * pow(max(radius_deg), 2)), 6) AS density FROM m GROUP BY 1")
def compare_regions(spark, sf_dir):
    return rounded(aggregates.compare_regions(stars(spark, sf_dir), regions(spark), "Hyades", "Praesepe"))


_HR = f"{_CM}, h AS (SELECT *, {_POP} AS population FROM q WHERE c IS NOT NULL AND m IS NOT NULL)"


@query("hr_statistics", f"{_HR} SELECT population, count(*) AS n, round(min(c), 6) AS min_color, round(max(c), 6) AS max_color, round(min(m), 6) AS min_mag, round(max(m), 6) AS max_mag FROM h GROUP BY 1")
def hr_statistics(spark, sf_dir):
    return rounded(aggregates.hr_statistics(aggregates.hr_points(stars(spark, sf_dir))))


@query("hr_grid", f"{_HR}, b AS (SELECT min(c) AS c0, max(c) AS c1, min(m) AS m0, max(m) AS m1 FROM h) SELECT CAST(least(floor((c - c0) / (c1 - c0) * 80), 79) AS INTEGER) AS column, CAST(least(floor((m - m0) / (m1 - m0) * 40), 39) AS INTEGER) AS row, count(*) AS n FROM h, b GROUP BY 1, 2")
def hr_grid(spark, sf_dir):
    return aggregates.hr_grid(aggregates.hr_points(stars(spark, sf_dir)))


@query("otype_distribution", f"{W} SELECT coalesce(nullif(trim(object_class), ''), 'Unknown') = 'Unknown' AS unknown, count(*) AS n FROM stars GROUP BY 1")
def otype_distribution(spark, sf_dir):
    d = aggregates.otype_distribution(stars(spark, sf_dir).withColumnRenamed("object_class", "otype"))
    return d.groupBy((F.col("otype") == "Unknown").alias("unknown")).agg(F.sum("n").alias("n"))


@query("cluster_physics", f"""{WR}, m AS (SELECT r.name AS region, {COLOUR} AS c, {M_G} AS m FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg)
SELECT region, count(*) AS n, round(coalesce(quantile_cont(c, 0.5), 0.5), 6) AS median_color, round(coalesce(quantile_cont(m, 0.5), 4.7), 6) AS median_mag FROM m GROUP BY 1""")
def cluster_physics(spark, sf_dir):
    return rounded(aggregates.cluster_physics(crossmatch.region_members(stars(spark, sf_dir), regions(spark))).select("region", "n", "median_color", "median_mag"))


@query("alert_type_counts", "SELECT event_type AS type, count(*) AS n FROM events WHERE event_id * 3 % 1500 IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def alert_type_counts(spark, sf_dir):
    return aggregates.type_counts(alerts(spark, sf_dir))


_SCORED = f"{_BASE}".replace("SELECT source_id, catalog, round(", "SELECT *, (").replace(", 6) AS base_score", ") AS score")
_TRUTH = f"coalesce({MOTION} >= 150, false) OR coalesce(ruwe >= 2.0, false) OR coalesce({COLOUR} >= 3.0 OR {COLOUR} <= -0.2, false)"


def _scored(spark, sf_dir):
    return discovery.base_score(stars(spark, sf_dir), profile("balanced")).withColumn("anomaly", stellar.physical_anomaly()).withColumnRenamed("base_score", "score")


@query("confusion", f"SELECT count(*) FILTER (score >= 8 AND t) AS tp, count(*) FILTER (score >= 8 AND NOT t) AS fp, count(*) FILTER (score < 8 AND t) AS fn, count(*) FILTER (score < 8 AND NOT t) AS tn FROM (SELECT *, {_TRUTH} AS t FROM ({_SCORED}))")
def confusion(spark, sf_dir):
    return aggregates.confusion(_scored(spark, sf_dir)).select("tp", "fp", "fn", "tn")


@query("batch_summary", f"SELECT count(*) AS n, count(*) FILTER (score > 10) AS high_score, count(*) FILTER (ruwe > 1.4 OR sqrt(pmra * pmra + pmdec * pmdec) > 100) AS anomalous, round(avg(phot_g_mean_mag), 6) AS mean_g, min(phot_g_mean_mag) AS min_g, max(phot_g_mean_mag) AS max_g FROM ({_SCORED})")
def batch_summary(spark, sf_dir):
    return rounded(aggregates.batch_summary(_scored(spark, sf_dir)))


@query("expert_recall", f"SELECT count(*) AS n, count(*) FILTER (score >= 10) AS found, round(count(*) FILTER (score >= 10) / count(*), 6) AS recall FROM ({_SCORED}) WHERE ruwe > 2.2")
def expert_recall(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return rounded(aggregates.expert_recall(s, s.where("ruwe > 2.2")))


@query("anomaly_totals")
def anomaly_totals(spark, sf_dir):
    members = crossmatch.region_members(_scored(spark, sf_dir), regions(spark))
    return aggregates.anomaly_totals(members)


@query("system_stats", "SELECT 'papers' AS what, count(*) AS n FROM documents UNION ALL SELECT 'stars', count(*) FROM orders UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def system_stats(spark, sf_dir):
    return aggregates.system_stats(stars=stars(spark, sf_dir), papers=papers(spark, sf_dir), vectors=table(spark, sf_dir, "embeddings"))


@query("literature_digest", f"{with_views('papers')} SELECT arxiv_id, title, left(abstract, 200) AS preview FROM papers ORDER BY published_date DESC, arxiv_id LIMIT 5")
def literature_digest(spark, sf_dir):
    return aggregates.literature_digest(papers(spark, sf_dir))


@query("keys_and_labels", f"""{W} SELECT source_id, replace({CATALOG}, ' ', '-') AS catalog, CASE WHEN {CATALOG} = 'GAIA' THEN source_id ELSE {CATALOG} || ':' || source_id END AS prefixed,
 round(180 / pi() * asin(sin(radians(27.12825)) * sin(radians(dec)) + cos(radians(27.12825)) * cos(radians(dec)) * cos(radians(122.93192 - ra))), 6) AS icrs_dec FROM stars""")
def keys_and_labels(spark, sf_dir):
    s = stars(spark, sf_dir)
    return s.select("source_id", normalize_catalog("catalog_source").alias("catalog"), prefix_source_id("catalog_source", "source_id").alias("prefixed"), F.round(galactic_to_icrs("ra", "dec")[1], 6).alias("icrs_dec"))


# --- text ------------------------------------------------------------------------------------------

WP = with_views("papers")


@query("paper_keys", f"""{WP}, h AS (SELECT arxiv_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(arxiv_id)) AS h FROM papers)
SELECT arxiv_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def paper_keys(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", uuid5_dns("arxiv_id").alias("point_id"))


@query("gaia_ids", rf"{WP} SELECT arxiv_id, unnest(list_distinct(regexp_extract_all(abstract, '(?i)\bGaia(?:\s+DR[23])?(?:\s+source(?:\s*id)?)?\s+(\d{{18,20}})\b', 1))) AS source_id FROM papers")
def gaia_ids(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", F.explode(tx.gaia_ids("abstract")).alias("source_id"))


@query("gaia_ids_near")
def gaia_ids_near(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", F.explode(tx.gaia_ids_near("abstract")).alias("source_id"))


_STRICT = " || ".join("list_transform(regexp_extract_all(abstract, '{}', 1), lambda x: upper(replace(x, ' ', '')))".format(p.replace("'", "''")) for p in tx.STRICT)


@query("catalog_ids", f"{WP} SELECT arxiv_id, unnest(list_distinct({_STRICT})) AS identifier FROM papers")
def catalog_ids(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", F.explode(tx.catalog_ids("abstract")).alias("i")).select("arxiv_id", F.upper(F.replace("i", F.lit(" "), F.lit(""))).alias("identifier"))


_MENTION = " UNION ALL ".join(f"SELECT arxiv_id, '{n}' AS cluster FROM papers WHERE " + " OR ".join(f"contains(lower(abstract), '{a}')" for a in al) for n, al in tx.CLUSTERS.items())


@query("cluster_mentions", f"{WP} {_MENTION}")
def cluster_mentions(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", F.explode(tx.cluster_mentions("abstract")).alias("cluster"))


@query("star_names")
def star_names(spark, sf_dir):
    return papers(spark, sf_dir).select("arxiv_id", F.explode(tx.star_names("abstract", ["Sirius", "Vega", "Spica"])).alias("star"))


def _piece(text: str, start: str) -> str:
    raw = f"substring({text}, {start} + 1, 1000)"
    dot = f"length({raw}) - strpos(reverse({raw}), '.')"
    return f"CASE WHEN {start} + 1000 < length({text}) AND contains({raw}, '.') AND {dot} > 800 THEN left({raw}, {dot} + 1) ELSE {raw} END"


_NEXT = "start + greatest(1, length(chunk) - 200)"


@query("paper_chunks", f"""{WP.replace('WITH', 'WITH RECURSIVE')}, c AS (SELECT arxiv_id, abstract AS t, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS chunk_no, {_piece('abstract', '0')} AS chunk FROM papers WHERE length(abstract) > 0
UNION ALL SELECT arxiv_id, t, {_NEXT}, chunk_no + 1, {_piece('t', f'({_NEXT})')} FROM c WHERE start + length(chunk) < length(t)) SELECT arxiv_id, chunk_no, chunk FROM c""")
def paper_chunks(spark, sf_dir):
    return documents.chunk_text(papers(spark, sf_dir))


_ID = r"regexp_extract_all(abstract, '(?i)\bGaia(?:\s+DR[23])?(?:\s+source(?:\s*id)?)?\s+(\d{18,20})\b', 1)"
WPS = with_views("stars", "papers")
_MENTIONED = f"e AS (SELECT DISTINCT arxiv_id, sid FROM (SELECT arxiv_id, unnest({_ID}) AS sid FROM papers) WHERE sid IN (SELECT source_id FROM stars))"


@query("link_stars_papers", f"{WPS}, {_MENTIONED} SELECT sid AS source_id, arxiv_id FROM e")
def link_stars_papers(spark, sf_dir):
    return documents.link_stars_papers(papers(spark, sf_dir), stars(spark, sf_dir)).select("source_id", "arxiv_id")


_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, '{t}')" for n, ts in tx.CLUSTERS.items() for i, t in enumerate(ts)) + ") AS t(key, term_no, term))"
_COVERS = f"""{_TERMS}, hits AS (SELECT arxiv_id, r.name AS cluster, term_no, term FROM papers, regions r JOIN terms ON key = lower(r.name) WHERE contains(lower(concat_ws(' ', title, categories, abstract)), term)),
covers AS (SELECT DISTINCT arxiv_id, cluster, term FROM hits h WHERE term_no = (SELECT min(term_no) FROM hits g WHERE g.cluster = h.cluster))"""


@query("link_papers_clusters", f"{with_views('papers', 'regions')}, {_COVERS} SELECT * FROM covers")
def link_papers_clusters(spark, sf_dir):
    return documents.link_papers_clusters(papers(spark, sf_dir), regions(spark))


@query("consistency", f"""{WPS}, {_MENTIONED}, j AS (SELECT sid AS source_id, arxiv_id, ruwe, {MOTION} AS pm, {COLOUR} AS c, lower(concat_ws(' ', abstract, title)) AS b FROM e JOIN papers USING (arxiv_id) JOIN stars ON source_id = sid),
k AS (SELECT *, {' OR '.join(f"contains(b, '{w}')" for w in tx.PHENOMENA['binary'])} AS is_b, {' OR '.join(f"contains(b, '{w}')" for w in tx.PHENOMENA['high_motion'])} AS is_f, {' OR '.join(f"contains(b, '{w}')" for w in tx.PHENOMENA['young'])} AS is_y FROM j)
SELECT source_id, arxiv_id, round(CASE WHEN is_b AND ruwe > 1.4 THEN 0.4 WHEN is_b AND ruwe <= 1.4 THEN -0.2 ELSE 0.0 END + CASE WHEN is_f AND pm > 50 THEN 0.4 WHEN is_f AND pm <= 50 THEN -0.2 ELSE 0.0 END + CASE WHEN is_y AND (c > 1.5 OR c < 0.5) THEN 0.3 ELSE 0.0 END, 2) AS consistency_score FROM k""")
def consistency(spark, sf_dir):
    p, s = papers(spark, sf_dir), stars(spark, sf_dir)
    pairs = documents.link_stars_papers(p, s).join(p, "arxiv_id").join(s, "source_id")
    return documents.consistency(pairs).select("source_id", "arxiv_id", "consistency_score")


# --- graph -----------------------------------------------------------------------------------------


_built: dict[tuple, str] = {}


def _edges(spark, sf_dir):
    """The edge table of the stars, papers and regions: built in the shared folder once an application and set of input files, then read."""
    of = (spark.sparkContext.applicationId, *(x for t in ("orders", "documents") for x in sorted(table(spark, sf_dir, t).inputFiles())))
    if of not in _built:
        path = new_path(spark, "graph")
        graph_store.build_graph(path, stars(spark, sf_dir), papers(spark, sf_dir), regions(spark))
        _built[of] = path
    return graph_store.read_edges(spark, _built[of])


WALL = with_views("stars", "papers", "regions")
_EDGES = f"""{WALL}, {_MENTIONED}, {_COVERS}, member AS (SELECT s.source_id, r.name AS cluster FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg)"""


@query("edge_counts", f"{_EDGES} SELECT 'MEMBER_OF' AS rel, count(*) AS n FROM member UNION ALL SELECT 'MENTIONED_IN', count(*) FROM e UNION ALL SELECT 'COVERS', count(*) FROM (SELECT DISTINCT arxiv_id, cluster FROM covers)")
def edge_counts(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("rel").agg(F.count("*").alias("n"))


def _by_paper(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{_BY_PAPER} AS id", "embedding AS vector")


_BY_PAPER = "CAST(2301 + vec_id % 12 AS STRING) || '.' || lpad(CAST(vec_id AS STRING), CAST(greatest(5, length(CAST(vec_id AS STRING))) AS INT), '0')"
_STAR_NAMES = "SELECT 'HD ' || CAST(48900 + CAST(right(source_id, 4) AS INT) % 40 AS STRING) AS name, min(source_id) AS source_id FROM {stars} WHERE source_id LIKE '%7' GROUP BY 1"


@query("graph_build", f"""{_EDGES}, rn AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS vec_id FROM regions), text AS (SELECT DISTINCT arxiv_id, cluster FROM covers),
v AS (SELECT {_BY_PAPER} AS arxiv_id, embedding FROM embeddings), near AS (SELECT rn.name AS cluster, v.arxiv_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM rn JOIN embeddings q USING (vec_id), v),
sem AS (SELECT cluster, arxiv_id FROM near WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, arxiv_id) <= 10),
n AS ({_STAR_NAMES.replace('{stars}', 'stars')}), said AS (SELECT arxiv_id, unnest(list_distinct({_STRICT})) AS i FROM papers),
ent AS (SELECT DISTINCT n.source_id, said.arxiv_id FROM said JOIN n ON said.i = upper(replace(n.name, ' ', '')) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.sid = n.source_id AND e.arxiv_id = said.arxiv_id)),
steps AS (SELECT 'clusters' AS step, count(*) AS created FROM regions UNION ALL SELECT 'stars', count(*) FROM stars UNION ALL SELECT 'membership', count(*) FROM member UNION ALL SELECT 'papers', count(*) FROM papers UNION ALL SELECT 'text_links', count(*) FROM text
 UNION ALL SELECT 'semantic_links', count(*) FROM sem WHERE arxiv_id IN (SELECT arxiv_id FROM papers) AND (arxiv_id, cluster) NOT IN (SELECT arxiv_id, cluster FROM text) UNION ALL SELECT 'id_links', count(*) FROM e UNION ALL SELECT 'entity_links', count(*) FROM ent
 UNION ALL SELECT 'citations', count(*) FROM documents WHERE doc_id >= 100)
SELECT step, created, CAST(0 AS BIGINT) AS created_again FROM steps""")
def graph_build(spark, sf_dir):
    """All steps of the build and what each creates, then all of them once more."""
    s, p, r = stars(spark, sf_dir), papers(spark, sf_dir), regions(spark)
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{_BY_PAPER} AS id", "embedding AS vector")
    order = Window.orderBy("name")  # a handful of regions
    near = r.select("name", (F.row_number().over(order) - 1).alias("vec_id")).join(v, "vec_id").select("name", F.col("vector").alias("query"))
    d = table(spark, sf_dir, "documents").where("doc_id >= 100").select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") - 100).alias("cited"))
    cites = d.selectExpr(f"{_BY_PAPER} AS citing", f"{_BY_PAPER.replace('vec_id', 'cited')} AS cited")
    path = new_path(spark, "graph")
    twice = [graph_store.build_graph(path, s, p, r, spark.sql(_STAR_NAMES, stars=s), v.select("id", "vector"), near, cites) for _ in range(2)]
    return spark.createDataFrame([(step, n, again) for (step, n), (_, again) in zip(*twice, strict=True)], "step string, created long, created_again long")


def _some(spark, sf_dir):
    return stars(spark, sf_dir).where("phot_g_mean_mag < 9").select("source_id")


@query("papers_of_star", f"{_EDGES}, i AS (SELECT source_id FROM stars WHERE phot_g_mean_mag < 9), u AS (SELECT source_id, arxiv_id, 'direct' AS link_type FROM i JOIN e ON sid = source_id UNION ALL SELECT DISTINCT source_id, arxiv_id, 'cluster_context' FROM i JOIN member USING (source_id) JOIN covers USING (cluster)) SELECT source_id, arxiv_id, max(link_type) AS link_type FROM u GROUP BY 1, 2")
def papers_of_star(spark, sf_dir):
    return graph.papers_of_star(_edges(spark, sf_dir), papers(spark, sf_dir), _some(spark, sf_dir), cluster_context=True).select("source_id", "arxiv_id", "link_type")


@query("related_stars", f"{_EDGES}, i AS (SELECT source_id FROM stars WHERE phot_g_mean_mag < 9), u AS (SELECT i.source_id, b.source_id AS related_id FROM i JOIN member a USING (source_id) JOIN member b USING (cluster) UNION SELECT i.source_id, b.sid FROM i JOIN e a ON a.sid = i.source_id JOIN e b USING (arxiv_id)) SELECT source_id, related_id, 2 AS hops FROM u WHERE source_id <> related_id")
def related_stars(spark, sf_dir):
    return graph.related_stars(_edges(spark, sf_dir), stars(spark, sf_dir), _some(spark, sf_dir), 2, None).select("source_id", "related_id", "hops")


@query("cluster_members", f"{_EDGES} SELECT source_id, phot_g_mean_mag FROM member JOIN stars USING (source_id) WHERE cluster = 'Hyades' ORDER BY phot_g_mean_mag NULLS LAST, source_id LIMIT 100")
def cluster_members(spark, sf_dir):
    return graph.cluster_members(_edges(spark, sf_dir), stars(spark, sf_dir), "Hyades").select("source_id", "phot_g_mean_mag")


@query("stars_in_paper", f"{WPS}, {_MENTIONED} SELECT arxiv_id, sid AS source_id FROM e")
def stars_in_paper(spark, sf_dir):
    return graph.stars_in_paper(_edges(spark, sf_dir), stars(spark, sf_dir), papers(spark, sf_dir)).select("arxiv_id", "source_id")


# --- vectors and hybrids ---------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector", "label")


@query("vector_topk", "WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    return rounded(vectors.vector_topk(v, q, 10, filters={"label": 3}).select("query_id", "id", "score", "rank"))


@query("vector_topk_lsh")
def vector_topk_lsh(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vectors.vector_topk_lsh(v, v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query"), 10)


_COSINES = "WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)"


@query("vector_index_search", f"{_COSINES} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_index_search(spark, sf_dir):
    """An inverted file of half the table, brought up to date with the rest and with changed rows, searched in all cells: the exact result."""
    v = _vectors(spark, sf_dir).select("id", "vector")
    path = new_path(spark, "index")
    ivf.build_index(v.where("id % 2 = 0").withColumn("vector", F.when(F.col("id") % 10 == 0, F.reverse("vector")).otherwise(F.col("vector"))), path)
    ivf.add_to_index(path, v.where("id % 2 = 1 OR id % 10 = 0"))
    found = ivf.search_index(spark, path, v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query"), 10, ivf.MOST_CELLS, 8)
    return rounded(found)


@query("vector_index_recall", "SELECT count(*) AS n_queries, true AS recall_reached, true AS few_exact_pairs FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def vector_index_recall(spark, sf_dir):
    """An inverted file over the whole table with as many probed cells as a recall of 0.9 asks for, held against the exact search."""
    v = _vectors(spark, sf_dir).select("id", "vector")
    q = v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    path = ivf.build_index(v, new_path(spark, "index"))
    asked = vectors.StatedQueries(q)
    nprobe, recall = ivf.tuned_nprobe(spark, path, asked, 10, 0.9, refine=2)
    cost = ivf.pairs_compared(spark, path, asked, 10, nprobe, refine=2)
    return spark.createDataFrame([(q.count(), recall >= 0.9, cost["exact"] <= 0.1 * cost["all"])], "n_queries long, recall_reached boolean, few_exact_pairs boolean")


@query("topic_search")
def topic_search(spark, sf_dir):
    p = vectors.embed_text(papers(spark, sf_dir), "abstract", 128, keep=["arxiv_id", "title", "categories"]).selectExpr("arxiv_id AS id", "vector", "title", "categories")
    q = p.where("CAST(substring_index(id, '.', -1) AS BIGINT) % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    return vectors.vector_topk(p, q, 10).select("query_id", "id", "title", "categories", "score", "rank")


@query("cone_with_context", f"""{_EDGES}, c AS (SELECT *, {sep('ra', 'dec', '66.75', '15.87')} AS d FROM stars WHERE ra IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY round(coalesce(ra, 0), 8), round(coalesce(dec, 0), 8), round(parallax, 6), round(phot_g_mean_mag, 6), round(phot_bp_mean_mag, 6), round(phot_rp_mean_mag, 6), catalog_source ORDER BY d, source_id) AS n FROM c WHERE d <= 10),
t AS (SELECT source_id, row_number() OVER (ORDER BY d, source_id) AS place FROM f WHERE n = 1), p AS (SELECT arxiv_id, source_id, place, row_number() OVER (PARTITION BY arxiv_id ORDER BY place, source_id) AS k FROM t JOIN e ON sid = source_id WHERE place <= 10)
SELECT 'star' AS section, source_id AS id, source_id, CAST(place AS INTEGER) AS place FROM t WHERE place <= 50 UNION ALL SELECT 'paper', arxiv_id, source_id, CAST(place AS INTEGER) FROM p WHERE k = 1""")
def cone_with_context(spark, sf_dir):
    return hybrid.cone_with_context(stars(spark, sf_dir), _edges(spark, sf_dir), papers(spark, sf_dir), 66.75, 15.87, 10.0)


_NEAREST = "(SELECT {0} AS query_id, vec_id AS id, score, row_number() OVER (PARTITION BY {0} ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS q, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id {1}) WHERE score IS NOT NULL)"
_RELATED = "(SELECT b.source_id AS related_id FROM member a JOIN member b USING (cluster) WHERE a.source_id = '{0}' UNION SELECT b.sid FROM e a JOIN e b USING (arxiv_id) WHERE a.sid = '{0}')"


@query("multi_search", f"""{_EDGES}, near AS ({_CONE.replace('d <= 10', 'd <= 5')} SELECT source_id, d FROM f WHERE n = 1 ORDER BY d, source_id LIMIT 20),
like_it AS {_NEAREST.format('q', '= 7')}, one AS (SELECT source_id, phot_g_mean_mag FROM stars WHERE source_id = '100000000000000049'),
around AS (SELECT related_id FROM {_RELATED.format('100000000000000049')} JOIN stars ON source_id = related_id WHERE related_id <> '100000000000000049' ORDER BY phot_g_mean_mag NULLS LAST, related_id LIMIT 10)
SELECT 'spatial' AS section, source_id AS id, round(d, 6) AS value FROM near UNION ALL SELECT 'semantic', CAST(id AS VARCHAR), round(score, 6) FROM like_it WHERE rank <= 20
UNION ALL SELECT 'star', source_id, round(phot_g_mean_mag, 6) FROM one UNION ALL SELECT 'related', related_id, CAST(2 AS DOUBLE) FROM around""")
def multi_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = hybrid.multi_search(stars(spark, sf_dir), _edges(spark, sf_dir), v, v.where("id = 7").selectExpr("id AS query_id", "vector AS query"), 66.75, 15.87, 5.0, "100000000000000049")
    return rounded(found)


@query("validate_with_literature", f"""{WPS}, c AS ({ORACLES['consistency']}), t AS (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY published_date DESC, arxiv_id DESC) AS n FROM c JOIN papers USING (arxiv_id)),
m AS (SELECT source_id, round(avg(consistency_score), 2) AS consistency, count(*) AS n FROM t WHERE n <= 5 GROUP BY 1)
SELECT source_id, consistency, m.n AS papers, m.n IS NOT NULL AS validated FROM stars LEFT JOIN m USING (source_id)""")
def validate_with_literature(spark, sf_dir):
    s = stars(spark, sf_dir)
    return hybrid.validate_with_literature(s, _edges(spark, sf_dir), papers(spark, sf_dir), s)


_REL = "rel AS (SELECT lang AS query, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1), rk AS (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id AS item FROM documents)"
_AT = "".join(
    f""", round(coalesce(h{k} / nullif(n{k}, 0), 0), 4) AS precision_{k}, round(coalesce(h{k} / nullif(nr, 0), 0), 4) AS recall_{k}, round(coalesce(2 * (h{k} / nullif(n{k}, 0)) * (h{k} / nullif(nr, 0)) / nullif(h{k} / nullif(n{k}, 0) + h{k} / nullif(nr, 0), 0), 0), 4) AS f1_{k},
 round(coalesce(d{k} / nullif(list_sum(list_transform(range(1, least(nr, {k}) + 1), lambda i: 1 / log2(i + 1))), 0), 0), 4) AS ndcg_{k}"""
    for k in (5, 10, 20)
)
_SUMS = "".join(f", count(*) FILTER (rank <= {k}) AS n{k}, count(*) FILTER (rank <= {k} AND hit) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k} AND hit), 0) AS d{k}" for k in (5, 10, 20))


@query("ir_metrics", f"WITH {_REL}, j AS (SELECT rk.*, rel.item IS NOT NULL AS hit FROM rk LEFT JOIN rel USING (query, item)), g AS (SELECT query, min(rank) FILTER (hit) AS first{_SUMS} FROM j GROUP BY query), nr AS (SELECT query, count(*) AS nr FROM rel GROUP BY query) SELECT query, round(coalesce(1 / first, 0), 4) AS mrr{_AT} FROM g LEFT JOIN nr USING (query)")
def ir_metrics(spark, sf_dir):
    from pyspark.sql import Window

    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = d.select(F.col("lang").alias("query"), F.row_number().over(order).alias("rank"), F.col("doc_id").alias("item"))
    relevant = d.join(lab.where("quality = 1"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"))
    return metrics.ir_metrics(ranked, relevant)


@query("min_count_score", "SELECT conv_id, least(1.0, count(*) / 4) AS score, CASE WHEN count(*) >= 4 THEN 'PASS' ELSE 'FAIL' END AS status FROM conversations GROUP BY conv_id")
def min_count_score(spark, sf_dir):
    n = messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("found")).withColumn("expected", F.lit(4))
    return n.select("conv_id", metrics.min_count_score("found", "expected").alias("s")).select("conv_id", "s.score", "s.status")


_MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in ["mrr"] + [f"{m}_{k}" for k in (5, 10, 20) for m in ("precision", "recall", "f1", "ndcg")])


@query("ablation", f"""{_EDGES}, rm AS (SELECT r.name AS region, s.*, {_IN} AS d FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg),
r1 AS (SELECT *, row_number() OVER (PARTITION BY region, round(coalesce(ra, 0), 8), round(coalesce(dec, 0), 8), round(parallax, 6), round(phot_g_mean_mag, 6), round(phot_bp_mean_mag, 6), round(phot_rp_mean_mag, 6), catalog_source ORDER BY d, source_id) AS n1 FROM rm),
r2 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY d, source_id) AS near, CASE WHEN is_transient = 1 THEN 15.0 ELSE 0.0 END + CASE WHEN ruwe >= 1.4 THEN 9.0 ELSE 0.0 END + CASE WHEN {COLOUR} <= -0.1 OR {COLOUR} >= 2.8 THEN 10.5 ELSE 0.0 END AS score FROM r1 WHERE n1 = 1 QUALIFY near <= 200),
st AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, near) AS best FROM r2),
rel AS (SELECT region AS query, source_id AS item FROM st WHERE score >= 10 OR {MOTION} >= 150 OR ruwe >= 2 OR {COLOUR} >= 3 OR {COLOUR} <= -0.2),
rv AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS q FROM regions),
ph AS (SELECT name AS region, arxiv_id, rank FROM {_NEAREST.format('q', '< 5')} JOIN rv ON q = query_id JOIN papers ON CAST(split_part(arxiv_id, '.', 2) AS BIGINT) = id WHERE rank <= 20),
ps AS (SELECT sid AS source_id, arxiv_id FROM e UNION SELECT source_id, arxiv_id FROM member JOIN covers USING (cluster)),
gr AS (SELECT region, arxiv_id, row_number() OVER (PARTITION BY region, source_id ORDER BY published_date DESC, arxiv_id DESC) AS n, best * 4 + n AS rank FROM st JOIN ps USING (source_id) JOIN papers USING (arxiv_id) WHERE best <= 10 QUALIFY n <= 3),
every AS (SELECT 'spatial' AS configuration, region AS query, near AS place, source_id AS item FROM st UNION ALL SELECT unnest(['hybrid', 'full']), region, best, source_id FROM st
 UNION ALL SELECT unnest(['semantic', 'hybrid', 'full']), region, 1000 + rank, 'paper:' || arxiv_id FROM ph UNION ALL SELECT 'full', region, 2000 + rank, 'paper:' || arxiv_id FROM gr),
fu AS (SELECT configuration, query, item, min(place) AS place FROM every GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY configuration, query ORDER BY place, item) AS rank FROM fu),
jn AS (SELECT rk.*, rel.item IS NOT NULL AS hit FROM rk LEFT JOIN rel USING (query, item)), gg AS (SELECT configuration, query, min(rank) FILTER (hit) AS first{_SUMS} FROM jn GROUP BY ALL), nr AS (SELECT query, count(*) AS nr FROM rel GROUP BY query),
pq AS (SELECT configuration, query, round(coalesce(1 / first, 0), 4) AS mrr{_AT} FROM gg LEFT JOIN nr USING (query)) SELECT configuration, {_MEANS} FROM pq GROUP BY configuration""")
def ablation(spark, sf_dir):
    s, r, p, v = stars(spark, sf_dir), regions(spark), papers(spark, sf_dir), _vectors(spark, sf_dir)
    hits = hybrid.region_hits(s, r)
    relevant = hits.where(stellar.physical_anomaly() | (F.col("discovery_score") >= 10)).select(F.col("region").alias("query"), F.col("source_id").alias("item"))
    place = F.row_number().over(Window.orderBy("name")) - 1  # five regions
    topics = r.select(F.col("name").alias("query_id"), place.alias("id")).join(v, "id").select("query_id", F.col("vector").alias("query"))
    near = vectors.vector_topk(v, topics, 20).select(F.col("query_id").alias("query"), "rank", "id")
    by_number = p.select("arxiv_id", F.expr("CAST(split_part(arxiv_id, '.', 2) AS BIGINT)").alias("id"))
    return hybrid.ablation(hits, near.join(by_number, "id").select("query", "rank", "arxiv_id"), relevant, _edges(spark, sf_dir), p)


# --- volume ----------------------------------------------------------------------------------------

_VOL = f"{W}, v AS (SELECT *, 1000 / parallax AS d FROM stars WHERE parallax > 0 ORDER BY coalesce(phot_g_mean_mag, 99), parallax DESC, source_id LIMIT 4000)"


@query("display_projection", f"{_VOL}, k AS (SELECT quantile_cont(d, 0.96) AS far, greatest(quantile_cont(d, 0.55), 25) AS a FROM v) SELECT source_id, round(d, 6) AS distance_pc, round(cos(radians(dec)) * cos(radians(ra)) * a * ln(1 + least(d, far) / a), 4) AS display_x_pc FROM v, k")
def display_projection(spark, sf_dir):
    p = volume.display_projection(volume.space_volume(stars(spark, sf_dir), 4000))
    return p.select("source_id", F.round("distance_pc", 6).alias("distance_pc"), F.round("display_x_pc", 4).alias("display_x_pc"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    p = volume.kmeans3d(volume.display_projection(volume.space_volume(stars(spark, sf_dir), 8000)))
    return aggregates.cluster_summary(p).join(volume.label_clusters(p, regions(spark)).select("cluster", "label"), "cluster", "left")


_TRACKS = ", ".join(f"('{t}', {c}, {m})" for t, points in volume.TRACKS.items() for c, m in points)


@query("nearest_track", f"""{W}, t AS (SELECT track, CAST(c AS DOUBLE) AS tc, CAST(m AS DOUBLE) AS tm FROM (VALUES {_TRACKS}) AS v(track, c, m)), p AS (SELECT source_id, {COLOUR} AS c, {M_G} AS m FROM stars),
k AS (SELECT source_id, track, c - tc AS residual, row_number() OVER (PARTITION BY source_id ORDER BY pow(m - tm, 2) + pow(c - tc, 2), track, c - tc) AS n FROM p, t WHERE c IS NOT NULL AND m IS NOT NULL)
SELECT source_id, track, CASE WHEN round(residual, 6) = 0 THEN 0 ELSE round(residual, 6) END AS color_residual FROM k WHERE n = 1""")
def nearest_track(spark, sf_dir):
    residual = F.round("color_residual", 6)
    nearest = volume.nearest_track(aggregates.hr_points(stars(spark, sf_dir)), volume.fiducial_tracks(spark))
    return nearest.select("source_id", "track", F.when(residual == 0, 0.0).otherwise(residual).alias("color_residual"))  # no minus zero


# --- sessions and upserts --------------------------------------------------------------------------


@query("last_messages", "SELECT conv_id, count(*) AS n_messages, left(arg_max(text, (turn, text)), 60) AS last_message FROM conversations GROUP BY conv_id")
def last_messages(spark, sf_dir):
    return sessions.last_messages(messages(spark, sf_dir))


@query("session_histories", "SELECT conv_id, turn, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k <= 3")
def session_histories(spark, sf_dir):
    return sessions.session_histories(messages(spark, sf_dir), 3)


@query("session_titles", "SELECT conv_id, left(arg_min(text, (turn, text)), 50) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_titles(spark, sf_dir):
    return sessions.session_titles(messages(spark, sf_dir))


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem"


@query("upsert", f"WITH t AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber >= 4 AND l_discount > 0.05 GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, CAST(price AS DOUBLE) AS price FROM b UNION ALL SELECT l_orderkey, l_linenumber, CAST(price AS DOUBLE) FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber)")
def upsert(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast("double"))
    target = lines.where("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.max("price").alias("price"))
    batch = lines.where("l_linenumber >= 4 AND l_discount > 0.05").select("l_orderkey", "l_linenumber", "price")
    return upserts.upsert(target, batch, ["l_orderkey", "l_linenumber"], "price")


@query("insert_ignore", f"{W} SELECT source_id, catalog_source FROM stars WHERE phot_g_mean_mag < 15 UNION ALL SELECT source_id, 'NEW' FROM stars WHERE phot_g_mean_mag >= 15 AND ruwe > 1")
def insert_ignore(spark, sf_dir):
    s = stars(spark, sf_dir).select("source_id", "catalog_source", "phot_g_mean_mag", "ruwe")
    target = s.where("phot_g_mean_mag < 15").select("source_id", "catalog_source")
    batch = s.where("ruwe > 1 AND phot_g_mean_mag IS NOT NULL").select("source_id", F.lit("NEW").alias("catalog_source"))
    return upserts.insert_ignore(target, batch, "source_id")


@query("upsert_transients", f"{with_views('stars', 'alerts')}, n AS (SELECT 'GSA_' || name AS source_id, name, ra, dec, mag, type, row_number() OVER (PARTITION BY name ORDER BY ra) AS k FROM alerts) SELECT source_id, catalog_source, is_transient, alert_name FROM stars UNION ALL SELECT source_id, 'GAIA_ALERTS', 1, name FROM n WHERE k = 1")
def upsert_transients(spark, sf_dir):
    return upserts.upsert_transients(stars(spark, sf_dir), alerts(spark, sf_dir)).select("source_id", "catalog_source", "is_transient", "alert_name")


@query("region_extract", f"{W} SELECT source_id FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 10 AND parallax > 0 AND phot_g_mean_mag < 18 ORDER BY source_id LIMIT 50 OFFSET 20")
def region_extract(spark, sf_dir):
    return upserts.region_extract(stars(spark, sf_dir), 66.75, 15.87, 10.0, 50, 20).select("source_id")


@query("region_extract_brightest", f"{WR}, m AS (SELECT s.source_id, r.name AS region, row_number() OVER (PARTITION BY r.name ORDER BY phot_g_mean_mag, s.source_id) AS rank FROM stars s JOIN regions r ON s.ra IS NOT NULL AND {_IN} <= r.radius_deg WHERE parallax IS NOT NULL AND phot_g_mean_mag IS NOT NULL) SELECT region, source_id, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 5")
def region_extract_brightest(spark, sf_dir):
    return upserts.region_extract_brightest(stars(spark, sf_dir), regions(spark), 5).select("region", "source_id", "rank")


@query("alert_times", "SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 40587.0, 6) AS mjd FROM events")
def alert_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(mjd(F.col("ts").cast("timestamp")), 6).alias("mjd"))


@query("volume_cone", f"{W} SELECT count(*) AS n FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '130.05', '19.52')} <= 2.5")
def volume_cone(spark, sf_dir):
    return aggregates.count_in_cone(stars(spark, sf_dir), 130.05, 19.52, 2.5)




_POP5 = "CASE WHEN m < 3 AND c < 0.8 THEN 'Main Sequence (O/B/A)' WHEN m < 1 AND c > 1.2 THEN 'Giant Branch' WHEN m > 10 THEN 'White Dwarf Candidate' WHEN c > 2.5 THEN 'M-Dwarf / Low Mass' WHEN m IS NOT NULL AND c IS NOT NULL THEN 'Main Sequence' END"


@query("stellar_analysis", f"{_CM} SELECT source_id, round(m, 2) + 0.0 AS abs_mag, CASE WHEN parallax > 0 THEN round(sqrt(pow(0.01, 2) + pow(5 / ln(10) * coalesce(parallax_error, 0.01) / parallax, 2)), 3) END AS abs_mag_error, round(c, 6) + 0.0 AS bp_rp, {_POP5} AS population FROM q")
def stellar_analysis(spark, sf_dir):
    found = hybrid.stellar_analysis(stars(spark, sf_dir))
    return found.select("source_id", (F.round("abs_mag", 2) + 0.0).alias("abs_mag"), "abs_mag_error", (F.round("bp_rp", 6) + 0.0).alias("bp_rp"), "population")


_DISTANCE_SQL = f"{W} SELECT source_id, round({sep('ra', 'dec', '83.82', '-5.39')}, 6) AS sep_deg, round({M_G}, 6) AS abs_mag FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '83.82', '-5.39')} <= 12"


@query("sql_functions", _DISTANCE_SQL)
def sql_functions(spark, sf_dir):
    from starloom.functions.sql import register_sql_functions

    register_sql_functions(spark)
    return spark.sql("SELECT source_id, round(sky_sep(ra, dec, 83.82D, -5.39D), 6) AS sep_deg, round(absolute_mag(phot_g_mean_mag, parallax), 6) AS abs_mag FROM {s} WHERE in_cone(ra, dec, 83.82D, -5.39D, 12D)", s=stars(spark, sf_dir))


@query("out_of_coverage", "SELECT round(avg(CASE WHEN o_custkey % 360 < 100 - 2 OR o_custkey % 360 > 200 + 2 OR o_custkey % 90 < 10 - 2 OR o_custkey % 90 > 40 + 2 THEN 1.0 ELSE 0.0 END), 6) AS outside FROM orders")
def out_of_coverage(spark, sf_dir):
    from starloom.operators.cone import out_of_coverage as test

    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 360).cast("double").alias("ra"), (F.col("o_custkey") % 90).cast("double").alias("dec"))
    box = spark.createDataFrame([(100.0, 200.0, 10.0, 40.0)], "min_ra double, max_ra double, min_dec double, max_dec double")
    return test(asked, box).agg(F.round(F.avg(F.when(F.col("out"), 1.0).otherwise(0.0)), 6).alias("outside"))


def _authority(spark, sf_dir):
    return stars(spark, sf_dir).where("catalog_source IN ('WISE', '2MASS')").select(F.col("source_id").alias("main_id"), "ra", "dec", F.col("object_class").alias("otype"))


@query("catalog_comparison")
def catalog_comparison(spark, sf_dir):
    return aggregates.catalog_comparison(crossmatch.cross_register(stars(spark, sf_dir), _authority(spark, sf_dir), 100.0))


@query("discovery_audit", f"""{W}, h AS (SELECT source_id, ra, dec, CAST(CASE WHEN is_transient = 1 THEN 15.0 ELSE 0.0 END + CASE WHEN ruwe >= 1.4 THEN 9.0 ELSE 0.0 END + CASE WHEN {COLOUR} <= -0.1 OR {COLOUR} >= 2.8 THEN 10.5 ELSE 0.0 END AS DOUBLE) AS discovery_score FROM stars WHERE ra IS NOT NULL AND {sep('ra', 'dec', '66.75', '15.87')} <= 10),
o AS (SELECT ra, dec FROM stars WHERE ra IS NOT NULL AND catalog_source IN ('WISE', '2MASS')), v AS (SELECT DISTINCT source_id FROM h JOIN o ON abs(h.dec - o.dec) < 0.03 AND {sep('h.ra', 'h.dec', 'o.ra', 'o.dec')} <= 100.0 / 3600)
SELECT source_id, discovery_score, CASE WHEN v.source_id IS NULL THEN 'New' ELSE 'Verified' END AS status FROM h LEFT JOIN v USING (source_id) WHERE discovery_score > 10""")
def discovery_audit(spark, sf_dir):
    return hybrid.discovery_audit(stars(spark, sf_dir), _authority(spark, sf_dir), 66.75, 15.87, 10.0, arcsec=100.0).select("source_id", "discovery_score", "status")


@query("semantic_cluster_links", f"SELECT 'region ' || query_id AS cluster, id AS arxiv_id, round(score, 6) AS score FROM {_NEAREST.format('q', '< 5')} WHERE rank <= 10")
def semantic_cluster_links(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    names = v.where("id < 5").select(F.concat(F.lit("region "), F.col("id").cast("string")).alias("name"), F.col("vector").alias("query"))
    return rounded(hybrid.link_papers_clusters_semantic(v, names))


@query("resolve_entities")
def resolve_entities(spark, sf_dir):
    s = stars(spark, sf_dir)
    authority = s.where("source_id LIKE '%7'").select("ra", "dec", "source_id")
    common = F.element_at(F.array(F.lit("sirius"), F.lit("hd 48915"), F.lit("hip 32349")), (F.col("source_id").substr(-2, 1).cast("int") % 3 + 1))
    named = authority.withColumn("name", F.when(F.col("source_id") <= "100000000000000027", common).otherwise(F.concat(F.lit("gaia dr3 "), "source_id")))
    return hybrid.resolve_entities(papers(spark, sf_dir), s, named.select("name", "ra", "dec"))
