"""Queries that combine positions, text, vectors and the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.cone import cone_search, lookup
from starloom.operators.documents import consistency, consistency_by_star
from starloom.operators.graph import papers_of_star, related_stars, stars_in_paper
from starloom.operators.metrics import ir_metrics
from starloom.operators.vectors import vector_topk
from starloom.plans.durable import durable


def cone_with_context(stars: DataFrame, edges: DataFrame, papers: DataFrame, ra: float, dec: float, radius: float, limit: int = 50, context_stars: int = 10) -> DataFrame:
    """(section, id, source_id, place): the cone's stars, then the papers of the first ten, each with its first star."""
    order = Window.orderBy("distance_deg", "source_id")  # over at most ``limit`` rows
    found = cone_search(stars, ra, dec, radius, limit).withColumn("place", F.row_number().over(order))
    some = found.where(F.col("place") <= context_stars)
    mentioned = papers_of_star(edges, papers, some).join(some.select("source_id", "place"), "source_id")
    once = Window.partitionBy("arxiv_id").orderBy("place", "source_id")
    mentioned = mentioned.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return found.select(F.lit("star").alias("section"), F.col("source_id").alias("id"), "source_id", "place").union(mentioned.select(F.lit("paper"), "arxiv_id", "source_id", "place"))


def semantic_with_stars(vectors: DataFrame, edges: DataFrame, stars: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's papers, with the stars that they mention."""
    hits = vector_topk(vectors, queries, k).select("query_id", F.col("id").alias("arxiv_id"), "score", "rank")
    named = stars_in_paper(edges, stars, hits.select("arxiv_id").distinct()).groupBy("arxiv_id").agg(F.array_sort(F.collect_set("source_id")).alias("stars"))
    return hits.join(named, "arxiv_id", "left").withColumn("stars", F.coalesce("stars", F.array().cast("array<string>")))


def multi_search(stars: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame | None = None, ra=None, dec=None, radius=None, source_id: str | None = None, limit: int = 20) -> DataFrame:
    """(section, id, value): a section for each kind of parameter that is given."""
    parts = []
    if ra is not None and dec is not None:
        parts.append(cone_search(stars, ra, dec, radius or 1.0, limit).select(F.lit("spatial").alias("section"), F.col("source_id").alias("id"), F.col("distance_deg").alias("value")))
    if queries is not None:
        parts.append(vector_topk(vectors, queries, limit).select(F.lit("semantic").alias("section"), F.col("id").cast("string").alias("id"), F.col("score").alias("value")))
    if source_id is not None:
        one = lookup(stars, source_id)
        parts.append(one.select(F.lit("star").alias("section"), F.col("source_id").alias("id"), F.col("phot_g_mean_mag").alias("value")))
        parts.append(related_stars(edges, stars, one, 2, 10).select(F.lit("related").alias("section"), F.col("related_id").alias("id"), F.col("hops").cast("double").alias("value")))
    return reduce(DataFrame.union, parts)


def validate_with_literature(stars: DataFrame, edges: DataFrame, papers: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """Consistency of each star with its newest papers; unvalidated without any."""
    pairs = papers_of_star(edges, papers, ids, limit=k).join(stars, "source_id")
    mean = consistency_by_star(consistency(pairs))
    return ids.select("source_id").join(mean, "source_id", "left").withColumn("validated", F.col("papers").isNotNull())


def discovery_audit(stars: DataFrame, authority: DataFrame, ra: float, dec: float, radius: float, threshold: float = 10.0, arcsec: float = 5.0) -> DataFrame:
    """Cone candidates above a score, each Verified by an authority table (main_id, ra, dec, otype) or New."""
    from starloom.functions.sky import in_cone
    from starloom.operators.cone import score_cone
    from starloom.operators.crossmatch import cross_register

    high = score_cone(stars.where(in_cone("ra", "dec", ra, dec, radius))).where(F.col("discovery_score") > threshold)
    return cross_register(high, authority, arcsec).withColumn("status", F.when(F.col("validated"), "Verified").otherwise("New"))


def link_papers_clusters_semantic(vectors: DataFrame, region_vectors: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, arxiv_id, score): the ``k`` papers nearest to each region's vector (name, query)."""
    hits = vector_topk(vectors, region_vectors.select(F.col("name").alias("query_id"), "query"), k)
    return hits.select(F.col("query_id").alias("cluster"), F.col("id").alias("arxiv_id"), "score")


#: Most names that are broadcast to the texts; beyond it a shuffled join.
BROADCAST_NAMES = 100_000
#: Most distinct first words of names that the texts are searched for; beyond it all runs are made.
FEW_FIRSTS = 100


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named_in_text(papers: DataFrame, names: DataFrame) -> DataFrame:
    """(arxiv_id, name): names that occur in papers as whole words, A-Z in any case. Runs of words of the text join names as equals, so any number of names will do.

    A run has all that stands between its words, so a name from its first word to its last is a run or occurs nowhere, and no text is looked at
    again; a name with other characters before or after its words is held against the texts that have the run. Only runs that begin with
    a name's first word are dealt out, and where the names are many only these meet them.
    """
    low = lambda c: F.translate(c, _CAPITALS, _SMALL)
    table = names.select("name").distinct().withColumn("_run", F.regexp_extract(low("name"), r"(?s)(\w(?:.*\w)?)", 1)).where("_run <> ''")
    table = table.withColumn("_words", F.regexp_count("_run", F.lit(r"\w+"))).withColumn("_first", F.regexp_extract("_run", r"^\w+", 0))
    bounds = table.groupBy("_words").agg(F.max(F.char_length("_run")).alias("most")).collect()  # a handful of lengths
    if not bounds:
        return papers.select("arxiv_id", F.lit("").alias("name")).limit(0)
    texts = papers.select("arxiv_id", low("abstract").alias("_text"))
    firsts = table.select("_first").distinct()
    some = [r[0] for r in firsts.limit(FEW_FIRSTS + 1).collect()]
    first = r"\w+" if len(some) > FEW_FIRSTS else f"(?:{'|'.join(sorted(some))})(?!\\w)"

    def runs(n: int, most: int):
        found = F.regexp_extract_all("_text", F.lit(rf"(?<!\w)(?=({first}(?:\W+\w+){{{n - 1}}}))"), 1)
        return F.filter(found, lambda x: F.char_length(x) <= most)

    said = texts.select("arxiv_id", F.explode(F.array_distinct(F.concat(*(runs(r["_words"], r.most) for r in bounds)))).alias("_run"))
    few = table.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    if not few and len(some) > FEW_FIRSTS:
        begins = F.broadcast(firsts) if firsts.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else firsts
        said = said.withColumn("_first", F.regexp_extract("_run", r"^\w+", 0)).join(begins, "_first", "left_semi").drop("_first")
    found = said.join(F.broadcast(table) if few else table, "_run").select("arxiv_id", "name", "_run").distinct()
    bare = F.char_length("name") == F.char_length("_run")
    more = found.where(~bare).join(papers.select("arxiv_id", "abstract"), "arxiv_id").where(F.rlike("abstract", F.concat(F.lit(r"(?i)(?<!\w)\Q"), "name", F.lit(r"\E(?!\w)"))))
    return found.where(bare).select("arxiv_id", "name").unionByName(more.select("arxiv_id", "name")).distinct()


def star_names(papers: DataFrame, names: DataFrame, k: int = 12) -> DataFrame:
    """(arxiv_id, place, star): the first ``k`` names of each abstract: loose identifiers as they stand, then the table's names (name) alphabetically.

    An identifier that ends in a component (A to C with a number, a Roman numeral, 1 to 6) is followed by what is left without it,
    if that is a name of the table. Names of any number meet the texts as runs of words. Case aside each name comes once;
    abstracts of under eight characters have none.
    """
    from starloom.functions.text import COMPONENT, LOOSE

    texts = papers.select("arxiv_id", "abstract").where(F.length(F.trim("abstract")) >= 8)
    found = F.transform(F.concat(*(F.regexp_extract_all("abstract", F.lit(p), 1) for p in LOOSE)), lambda x: F.trim(x))
    raw = texts.select("arxiv_id", F.posexplode(found).alias("at", "star"))
    table = names.select("name").where("name IS NOT NULL").distinct()
    short = raw.withColumn("name", F.trim(F.regexp_replace("star", COMPONENT, ""))).where("name <> star").join(table, "name", "left_semi").select("arxiv_id", (2 * F.col("at") + 1).alias("at"), F.col("name").alias("star"))
    common = named_in_text(texts, table).select("arxiv_id", F.lit(2**31 - 1).alias("at"), F.col("name").alias("star"))
    every = raw.select("arxiv_id", (2 * F.col("at")).alias("at"), "star").unionByName(short).unionByName(common)
    once = every.groupBy("arxiv_id", F.lower("star").alias("_low")).agg(F.min(F.struct("at", "star")).alias("s"))
    order = Window.partitionBy("arxiv_id").orderBy("s.at", "s.star")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("arxiv_id", "place", F.col("s.star").alias("star"))


def resolve_entities(papers: DataFrame, stars: DataFrame, authority: DataFrame, arcsec: float = 5.0) -> DataFrame:
    """(arxiv_id, source_id): Gaia ids as they are, other names by their position; clusters are no stars."""
    from starloom.functions.text import CLUSTERS, LOOSE, catalog_ids, gaia_ids_near
    from starloom.operators.crossmatch import resolve_names

    ids = papers.select("arxiv_id", F.explode(gaia_ids_near("abstract")).alias("source_id"))
    catalog = papers.select("arxiv_id", F.explode(F.array_union(catalog_ids("abstract"), catalog_ids("abstract", LOOSE))).alias("name"))
    named = catalog.union(named_in_text(papers, authority)).withColumn("name", F.lower("name")).where(~F.col("name").isin(list(CLUSTERS)))
    named = durable(named.distinct(), "named")  # small beside the texts, which are searched once
    found = named.join(resolve_names(named, stars, authority, arcsec), "name").select("arxiv_id", "source_id")
    return ids.union(found).distinct()


def fuse_results(star_hits: DataFrame, paper_hits: DataFrame, graph_hits: DataFrame | None = None) -> DataFrame:
    """(query, rank, item): star ids, then paper:<id> of the search and of the graph, repeats left out, in order."""
    lists = [star_hits.select("query", F.lit(0).alias("part"), "rank", F.col("source_id").alias("item"))]
    for part, hits in enumerate((paper_hits, graph_hits), 1):
        if hits is not None:
            lists.append(hits.select("query", F.lit(part), "rank", F.concat(F.lit("paper:"), F.col("arxiv_id"))))
    first = reduce(DataFrame.union, lists).groupBy("query", "item").agg(F.min(F.struct("part", "rank")).alias("at"))
    order = Window.partitionBy("query").orderBy("at", "item")
    return first.withColumn("rank", F.row_number().over(order)).select("query", "rank", "item")


def region_hits(stars: DataFrame, regions: DataFrame, limit: int = 200) -> DataFrame:
    """The nearest stars of each region, a measurement counting once, with discovery_score and their places by_distance and by_score."""
    from starloom.functions.sky import separation_deg
    from starloom.operators.cone import dedupe_measurements, score_cone
    from starloom.operators.crossmatch import region_members

    members = region_members(stars, regions).withColumn("d", separation_deg("ra", "dec", "region_ra", "region_dec"))
    near = Window.partitionBy("region").orderBy("d", "source_id")
    nearest = dedupe_measurements(members, "d", "source_id", within=["region"]).withColumn("by_distance", F.row_number().over(near)).where(F.col("by_distance") <= limit)
    best = Window.partitionBy("region").orderBy(F.desc("discovery_score"), "by_distance")
    return score_cone(nearest).withColumn("by_score", F.row_number().over(best))


def graph_hits(hits: DataFrame, edges: DataFrame, papers: DataFrame, first: int = 10, each: int = 3) -> DataFrame:
    """(query, rank, arxiv_id): the newest papers of each region's ``first`` stars, those of their clusters too."""
    top = hits.where(F.col("by_score") <= first).select(F.col("region").alias("query"), "source_id", "by_score")
    found = papers_of_star(edges, papers, top.select("source_id").distinct(), cluster_context=True, limit=each).select("source_id", "arxiv_id", "published_date")
    newest = Window.partitionBy("query", "source_id").orderBy(F.desc("published_date"), F.desc("arxiv_id"))
    return top.join(found, "source_id").withColumn("rank", F.col("by_score") * (each + 1) + F.row_number().over(newest)).select("query", "rank", "arxiv_id")


def ablation(hits: DataFrame, paper_hits: DataFrame, relevant: DataFrame, edges: DataFrame, papers: DataFrame, ks=(5, 10, 20)) -> DataFrame:
    """Mean metrics over the regions of four configurations: stars by distance, papers by topic, both with stars by score, and these with the graph's papers.

    ``hits`` are ``region_hits``, ``paper_hits`` (query, rank, arxiv_id) a search by each region's topic.
    """
    from starloom.operators.metrics import mean_metrics

    ranked = lambda by: hits.select(F.col("region").alias("query"), F.col(by).alias("rank"), "source_id")
    near, best = ranked("by_distance"), ranked("by_score")
    runs = {
        "spatial": fuse_results(near, paper_hits.limit(0)),
        "semantic": fuse_results(near.limit(0), paper_hits),
        "hybrid": fuse_results(best, paper_hits),
        "full": fuse_results(best, paper_hits, graph_hits(hits, edges, papers)),
    }
    return reduce(DataFrame.union, (mean_metrics(ir_metrics(r, relevant, ks)).withColumn("configuration", F.lit(c)) for c, r in runs.items()))


def stellar_analysis(stars: DataFrame) -> DataFrame:
    """Add abs_mag, abs_mag_error, bp_rp and population."""
    from starloom.functions import stellar

    colour, m_g = stellar.bp_rp(), stellar.absolute_mag()
    return stars.withColumns({"abs_mag": m_g, "abs_mag_error": stellar.absolute_mag_error(0.01, "parallax", "parallax_error"), "bp_rp": colour, "population": stellar.population5(colour, m_g)})


def research_profile(stars: DataFrame, field: DataFrame, catalogs: dict[str, DataFrame] | None = None, ebv: float = 0.05, arcsec: float = 2.0) -> DataFrame:
    """The stellar analysis with binary_limit, dereddened values, the SED and its teff_k, the density ratio of the star's
    surroundings in ``field``, and its matches in external ``catalogs``: a map from catalog to the nearest five rows."""
    from starloom.functions import stellar
    from starloom.operators.aggregates import density_anomaly
    from starloom.operators.crossmatch import xmatch_catalogs

    out = stellar_analysis(stars).withColumns({"binary_limit": stellar.binary_separation(), "dereddened": stellar.deredden(ebv), "sed": stellar.sed(list(stellar.FILTERS)[:3])}).withColumn("teff_k", stellar.wien_teff("sed"))
    out = out.join(density_anomaly(field).select("source_id", "ratio", "is_peak"), "source_id", "left")
    if catalogs:
        pairs = F.collect_list(F.struct("catalog", "matches"))  # one for each catalog
        out = out.join(xmatch_catalogs(stars, catalogs, arcsec).groupBy("source_id").agg(F.map_from_entries(pairs).alias("external")), "source_id", "left")
    return out
