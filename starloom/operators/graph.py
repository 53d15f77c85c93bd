"""Property-graph lookups over an edge table (src_type, src, rel, dst_type, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.durable import durable


def edges_from(pairs: DataFrame, src_type: str, rel: str, dst_type: str, src: str, dst: str) -> DataFrame:
    return pairs.select(F.lit(src_type).alias("src_type"), F.col(src).cast("string").alias("src"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(dst).cast("string").alias("dst")).distinct()


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges that are not there yet; with ``nodes`` (kind, id) only those with both ends known."""
    if nodes is not None:
        for side in ("src", "dst"):
            new = new.join(nodes.select(F.col("kind").alias(f"{side}_type"), F.col("id").alias(side)), [f"{side}_type", side], "left_semi")
    return edges.unionByName(new.select(*edges.columns).distinct().join(edges, edges.columns, "left_anti"))


def build_edges(stars: DataFrame, papers: DataFrame, regions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Membership, mention and coverage edges of stars, papers and regions."""
    from starloom.operators.crossmatch import region_members
    from starloom.operators.documents import link_papers_clusters, link_stars_papers

    member = edges_from(region_members(stars, regions), "Star", "MEMBER_OF", "Cluster", "source_id", "region")
    mention = edges_from(link_stars_papers(papers, stars, names), "Star", "MENTIONED_IN", "Paper", "source_id", "arxiv_id")
    covers = edges_from(link_papers_clusters(papers, regions), "Paper", "COVERS", "Cluster", "arxiv_id", "cluster")
    return member.unionByName(mention).unionByName(covers)


def _rel(edges: DataFrame, rel: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("rel") == rel).select(F.col("src").alias(src), F.col("dst").alias(dst))


#: Ids of a key that one row keeps together, and rows that meet them in a task's share.
CHUNK, SHARE = 16384, 4096
#: Tasks that make pairs, at least: what they read is small, so its size says nothing of their work.
TASKS = 256


def _meet(ids: DataFrame, rows: DataFrame, key: str, row: str, known: DataFrame, least: int = 1) -> DataFrame:
    """(source_id, columns of known): distinct ids (source_id, key) and rows (row, key) that share a key, each pair once; ``known`` has the rows' columns.

    Keys may be few. Ids of the same keys lie together in arrays, so a pair costs an element of an array and no comparison of its
    keys: whether a key is the least that both sides share is told once an array and row. A large key's arrays and rows are dealt
    over tasks as its size asks for, and no pair is shuffled. Keys of fewer than ``least`` rows are left out.
    """
    count = lambda side, name: side.groupBy(key).agg(F.count("*").alias(name))
    sizes = count(rows, "_rows").where(F.col("_rows") >= least).join(count(ids, "_ids"), key)
    cuts = F.struct(F.col(key), F.ceil(F.col("_ids") / CHUNK).cast("int").alias("_a"), F.ceil(F.col("_rows") / SHARE).cast("int").alias("_b"))

    def listed(side: DataFrame, by: str, name: str) -> DataFrame:
        found = side.join(sizes, key).groupBy(by).agg(F.array_sort(F.collect_set(cuts)).alias("_keys"))
        return found.select(by, F.col(f"_keys.{key}").alias(name), F.explode("_keys").alias("_k")).select(by, name, "_k.*")

    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = listed(ids, "source_id", "_own").withColumn("_a", part("source_id", "_a"))
    ours = ours.groupBy(key, "_a", "_b", "_own").agg(F.collect_list("source_id").alias("_together")).withColumn("_b", every("_b"))
    theirs = listed(rows, row, "_its").join(known, row).withColumn("_b", part(row, "_b")).withColumn("_a", every("_a"))
    tasks = max(TASKS, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    theirs, ours = (side.repartition(tasks, key, "_a", "_b") for side in (theirs, ours))
    met = theirs.join(ours.hint("merge"), [key, "_a", "_b"])
    first = (F.size("_own") == 1) | (F.size("_its") == 1) | (F.array_min(F.array_intersect("_own", "_its")) == F.col(key))
    return met.where(first).select(F.explode("_together").alias("source_id"), *known.columns)


def cluster_papers(edges: DataFrame, papers: DataFrame, ids: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """(source_id, paper columns): papers about the clusters of each star, each pair once; without those of ``but`` (source_id, arxiv_id)."""
    of_star = durable(ids.select("source_id").join(_rel(edges, "MEMBER_OF", "source_id", "cluster"), "source_id").distinct(), "ids")
    known = papers
    if but is not None:
        known = known.join(but.groupBy("arxiv_id").agg(F.collect_set("source_id").alias("_but")), "arxiv_id", "left")
    met = _meet(of_star, _rel(edges, "COVERS", "arxiv_id", "cluster").distinct(), "cluster", "arxiv_id", known)
    if but is not None:
        met = met.where(F.col("_but").isNull() | ~F.array_contains("_but", F.col("source_id")))
    return met.select("source_id", *papers.columns)


def papers_of_star(edges: DataFrame, papers: DataFrame, ids: DataFrame, cluster_context: bool = False, limit: int | None = None) -> DataFrame:
    """Papers that mention each star, optionally those about its clusters too, newest first."""
    pairs = ids.select("source_id").join(_rel(edges, "MENTIONED_IN", "source_id", "arxiv_id"), "source_id").distinct()
    if cluster_context:
        once = papers.dropDuplicates(["arxiv_id"])
        context = cluster_papers(edges, once, ids, but=pairs).withColumn("link_type", F.lit("cluster_context"))
        out = pairs.join(once, "arxiv_id").withColumn("link_type", F.lit("direct")).unionByName(context)
    else:
        out = pairs.join(papers, "arxiv_id").withColumn("link_type", F.lit("direct"))
    if limit is None:
        return out
    newest = Window.partitionBy("source_id").orderBy(F.desc("published_date"), F.desc("arxiv_id"))
    return out.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def related_factors(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars two edges away, as factors: (source_id, hub) and (hub, related_id).

    Their join on ``hub``, without equal ends, is what ``related_stars`` gives at two hops without a limit; the factors have a
    row for each edge and never pair the members of a large hub off against each other.
    """
    ends = _star_ends(edges)
    left = durable(ids.select("source_id").join(ends, "source_id").distinct(), "ids")
    return left, ends.distinct().join(left.select("hub").distinct(), "hub", "left_semi").select("hub", F.col("source_id").alias("related_id"))


def _star_ends(edges: DataFrame) -> DataFrame:
    """(source_id, hub): stars and what is at the other end of each of their edges."""
    both = edges.select("src_type", "src", "dst_type", "dst").unionByName(edges.select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst")))
    return both.where("src_type = 'Star'").select(F.col("src").alias("source_id"), F.concat_ws(":", "dst_type", "dst").alias("hub"))


def _two_away(edges: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_id, related_id, hops, ...): ``related_stars`` at two hops without a limit, from the factors; no pair is shuffled."""
    left, right = related_factors(edges, ids)
    # Stars with edges alone, once for both distances; asked ones with edges are in the factor.
    known = durable(known.join(_star_ends(edges).select(F.col("source_id").alias("related_id")).distinct(), "related_id", "left_semi"), "ends")
    two = _meet(left, right, "hub", "related_id", known, least=2).where("source_id <> related_id")
    direct = edges.where("src_type = 'Star' AND dst_type = 'Star'")
    both = direct.select(F.col("src").alias("source_id"), F.col("dst").alias("related_id")).union(direct.select("dst", "src"))
    one = both.where("source_id <> related_id").distinct().join(left.select("source_id").distinct(), "source_id").join(known, "related_id")
    return one.withColumn("hops", F.lit(1)).unionByName(two.select(*one.columns).withColumn("hops", F.lit(2)))


def related_stars(edges: DataFrame, stars: DataFrame, ids: DataFrame, max_hops: int = 2, limit: int | None = 50) -> DataFrame:
    """(source_id, related_id, hops): stars on paths of up to ``max_hops`` edges, in any direction, no edge used twice.

    A star may appear at several distances. Paths are kept as one row per end and edges used. With a ``limit`` the
    last step takes from a node only so many of its brightest stars as can reach the result, so two members of a
    large cluster are never paired off against all others.
    """
    bright = ["phot_g_mean_mag", "related_id"]
    known = stars.select(F.col("source_id").alias("related_id"), "phot_g_mean_mag")
    if max_hops == 2 and limit is None:
        return _two_away(edges, known, ids)
    numbered = edges.select("src_type", "src", "dst_type", "dst", F.xxhash64(*edges.columns).alias("e"))
    both = numbered.select(F.concat_ws(":", "src_type", "src").alias("u"), F.concat_ws(":", "dst_type", "dst").alias("v"), "e").union(numbered.select(F.concat_ws(":", "dst_type", "dst"), F.concat_ws(":", "src_type", "src"), "e"))
    paths = ids.select("source_id", F.concat(F.lit("Star:"), F.col("source_id")).alias("at"), F.array().cast("array<bigint>").alias("used"))
    found = None
    for hops in range(1, max_hops + 1):
        if limit is not None and hops == max_hops:
            # A path can miss the star that it began at, and one end for each edge that it has used.
            ends = both.where("v LIKE 'Star:%'").select("u", "v", F.expr("substring(v, 6)").alias("related_id")).distinct().join(known, "related_id")
            first = Window.partitionBy("u").orderBy(*(F.asc_nulls_last(c) for c in bright))
            best = ends.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + max_hops).select("u", "v")
            both = both.join(best, ["u", "v"], "left_semi")
        paths = paths.join(both, paths["at"] == both["u"]).where(~F.array_contains("used", F.col("e"))).select("source_id", F.col("v").alias("at"), F.array_append("used", F.col("e")).alias("used")).distinct()
        ends = paths.where("at LIKE 'Star:%'").select("source_id", F.expr("substring(at, 6)").alias("related_id"), F.lit(hops).alias("hops")).where("related_id <> source_id").distinct()
        found = ends if found is None else found.union(ends)
    out = found.join(known, "related_id")
    if limit is None:
        return out
    order = Window.partitionBy("source_id").orderBy("hops", *(F.asc_nulls_last(c) for c in bright))
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def cluster_members(edges: DataFrame, stars: DataFrame, name: str, limit: int = 100) -> DataFrame:
    return _rel(edges, "MEMBER_OF", "source_id", "cluster").where(F.col("cluster") == name).join(stars, "source_id").orderBy(F.asc_nulls_last("phot_g_mean_mag"), "source_id").limit(limit)


def stars_in_paper(edges: DataFrame, stars: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("arxiv_id").join(_rel(edges, "MENTIONED_IN", "source_id", "arxiv_id"), "arxiv_id").join(stars, "source_id")


def star_by_name(stars: DataFrame, names: DataFrame, authority: DataFrame, arcsec: float = 5.0) -> DataFrame:
    """(name, source_id): by alert name where a star has it, else by the name's position."""
    from starloom.operators.crossmatch import resolve_names

    asked = names.select(F.lower(F.trim("name")).alias("name")).distinct()
    by_name = stars.where("alert_name IS NOT NULL").groupBy(F.lower("alert_name").alias("name")).agg(F.min("source_id").alias("s1"))
    by_place = resolve_names(names, stars, authority, arcsec).select("name", F.col("source_id").alias("s2"))
    return asked.join(by_name, "name", "left").join(by_place, "name", "left").select("name", F.coalesce("s1", "s2").alias("source_id"))
