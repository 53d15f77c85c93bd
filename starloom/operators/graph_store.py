"""The property graph as two tables: nodes by kind, edges by relation, built step by step and only ever with what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.graph import edges_from
from starloom.plans.durable import durable

EDGE = ["src_type", "src", "rel", "dst_type", "dst"]
_EDGES = "src_type string, src string, dst_type string, dst string, rel string"
_NODES = "id string, kind string"


def read_edges(spark: SparkSession, path: str, *rels: str) -> DataFrame:
    """Edges (src_type, src, rel, dst_type, dst); of the named relations only, whose folders alone are read."""
    edges = spark.read.schema(_EDGES).parquet(f"{path}/edges").select(*EDGE)
    return edges.where(F.col("rel").isin(*rels)) if rels else edges


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODES).parquet(f"{path}/nodes").select("kind", "id")


def create_store(spark: SparkSession, path: str) -> str:
    """Empty tables, if there are none yet."""
    spark.createDataFrame([], _EDGES).write.mode("ignore").partitionBy("rel").parquet(f"{path}/edges")
    spark.createDataFrame([], _NODES).write.mode("ignore").partitionBy("kind").parquet(f"{path}/nodes")
    return path


def add_nodes(path: str, kind: str, batch: DataFrame, key: str) -> int:
    """Add the nodes of a kind that are not there yet; how many they were. A null key is no node."""
    spark = batch.sparkSession
    new = batch.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    nodes = lambda: read_nodes(spark, path).where(F.col("kind") == kind)
    if before := nodes().count():
        new = new.join(nodes().select("id"), "id", "left_anti")
    # Files that were read are not touched by an append, so nodes are written once.
    new.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(f"{path}/nodes")
    return nodes().count() - before


def _append(new: DataFrame, path: str, by: str) -> int:
    """Append rows to the partition they belong to; they were found by reading the table, so they are written apart first."""
    new = durable(new, "new")
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(by).parquet(path)
    return n


def add_links(path: str, links: DataFrame, refresh: bool = False) -> int:
    """Add edges (src_type, src, rel, dst_type, dst) whose ends are nodes and that are not there yet; how many were created.

    A build that stops half-way is finished by running it again. With ``refresh`` the relations that the links are of are
    written anew (their partitions alone are overwritten), so links that no longer hold go.
    """
    spark = links.sparkSession
    nodes, known = read_nodes(spark, path), links.select(*EDGE).distinct()
    for side in ("src", "dst"):
        known = known.join(nodes.select(F.col("kind").alias(f"{side}_type"), F.col("id").alias(side)), [f"{side}_type", side], "left_semi")
    there = read_edges(spark, path)
    if not refresh:
        return _append(known.join(there, EDGE, "left_anti").select(*EDGE), f"{path}/edges", "rel")
    new = durable(known.select(*EDGE), "new")
    created = new.join(there, EDGE, "left_anti").count()
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rel").parquet(f"{path}/edges")
    return created


def link_stars_clusters(path: str, members: DataFrame) -> int:
    """Star to cluster of (source_id, region)."""
    return add_links(path, edges_from(members, "Star", "MEMBER_OF", "Cluster", "source_id", "region"))


def link_stars_papers(path: str, mentions: DataFrame) -> int:
    """Star to paper of (source_id, arxiv_id); how many were not there before."""
    return add_links(path, edges_from(mentions, "Star", "MENTIONED_IN", "Paper", "source_id", "arxiv_id"))


def link_papers_clusters(path: str, covers: DataFrame) -> int:
    """Paper to cluster of (arxiv_id, cluster)."""
    return add_links(path, edges_from(covers, "Paper", "COVERS", "Cluster", "arxiv_id", "cluster"))


def link_papers(path: str, citations: DataFrame) -> int:
    """Paper to paper of (citing, cited)."""
    return add_links(path, edges_from(citations, "Paper", "CITES", "Paper", "citing", "cited"))


def build_graph(path: str, stars: DataFrame, papers: DataFrame, regions: DataFrame, names: DataFrame | None = None, vectors: DataFrame | None = None, region_vectors: DataFrame | None = None, citations: DataFrame | None = None, nearest: int = 10) -> list[tuple[str, int]]:
    """All steps in order, each as (step, nodes or links created); a second run over the same tables creates nothing.

    Clusters, stars, membership, papers, clusters named in texts, clusters near in meaning (``vectors`` (id, vector) by
    arxiv_id, ``region_vectors`` (name, query)), star ids in texts, names in texts (``names`` (name, source_id)), citations
    (citing, cited). A link that two steps find is created by the first. Steps whose tables are not given are left out.
    """
    from starloom.operators import crossmatch, documents, hybrid

    create_store(stars.sparkSession, path)
    done = [("clusters", add_nodes(path, "Cluster", regions, "name")), ("stars", add_nodes(path, "Star", stars, "source_id"))]
    done.append(("membership", link_stars_clusters(path, crossmatch.region_members(stars, regions))))
    done.append(("papers", add_nodes(path, "Paper", papers, "arxiv_id")))
    done.append(("text_links", link_papers_clusters(path, documents.link_papers_clusters(papers, regions))))
    if vectors is not None and region_vectors is not None:
        done.append(("semantic_links", link_papers_clusters(path, hybrid.link_papers_clusters_semantic(vectors, region_vectors, nearest))))
    done.append(("id_links", link_stars_papers(path, documents.link_stars_papers(papers, stars))))
    if names is not None:
        done.append(("entity_links", link_stars_papers(path, documents.link_stars_papers(papers, stars, names))))
    if citations is not None:
        done.append(("citations", link_papers(path, citations)))
    return done
