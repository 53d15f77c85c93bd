"""The graph tables against sets of edges, built once, again and with changes."""

import random

import pytest

from starloom.operators import graph
from starloom.operators import graph_store as store


@pytest.fixture(scope="module")
def world(spark):
    stars = spark.createDataFrame([(f"10000000000000000{i}", 10.0 + i, 10.0) for i in range(8)] + [(None, 1.0, 1.0)], "source_id string, ra double, dec double")
    papers = spark.createDataFrame([("1", "On the Pleiades", "Gaia DR3 100000000000000001 and HD 48915", "x"), ("2", "Plain", "nothing", "x"), ("3", "Both", "HD 48915, HD 48915", "x")], "arxiv_id string, title string, abstract string, categories string")
    regions = spark.createDataFrame([("Pleiades", 10.0, 10.0, 2.5), ("Hyades", 90.0, 10.0, 1.0)], "name string, ra double, dec double, radius_deg double")
    return stars, papers, regions


def test_build_is_incremental_and_idempotent(spark, world, tmp_path):
    stars, papers, regions = world
    names = spark.createDataFrame([("HD 48915", "100000000000000002"), ("hd48915", "100000000000000001"), ("HD 1", "100000000000000003"), ("HD 48915", "999")], "name string, source_id string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.9, 0.1]), ("9", [1.0, 0.1])], "id string, vector array<double>")
    near = spark.createDataFrame([("Pleiades", [1.0, 0.0]), ("Nowhere", [1.0, 0.0])], "name string, query array<double>")
    cites = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "7"), (None, "1")], "citing string, cited string")
    path = str(tmp_path / "g")
    build = lambda: dict(store.build_graph(path, stars, papers, regions, names, vectors, near, cites))
    want = {"clusters": 2, "stars": 8, "membership": 3, "papers": 3, "text_links": 1, "semantic_links": 1, "id_links": 1, "entity_links": 3, "citations": 1}
    assert build() == want
    first = {tuple(r) for r in store.read_edges(spark, path).collect()}
    assert build() == dict.fromkeys(want, 0) and {tuple(r) for r in store.read_edges(spark, path).collect()} == first
    assert store.read_edges(spark, path).count() == len(first) == 10
    more = spark.createDataFrame([("100000000000000007", "2"), ("100000000000000001", "1")], "source_id string, arxiv_id string")
    assert store.link_stars_papers(path, more) == 1
    plan = store.read_edges(spark, path, "CITES")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan


def test_refresh_rewrites_one_relation(spark, world, tmp_path):
    stars, papers, regions = world
    path = str(tmp_path / "g")
    store.build_graph(path, stars, papers, regions)
    others = {tuple(r) for r in store.read_edges(spark, path).where("rel <> 'MEMBER_OF'").collect()}
    only = graph.edges_from(spark.createDataFrame([("100000000000000005", "Hyades"), ("gone", "Hyades")], "s string, c string"), "Star", "MEMBER_OF", "Cluster", "s", "c")
    assert store.add_links(path, only, refresh=True) == 1
    assert [(r.src, r.dst) for r in store.read_edges(spark, path, "MEMBER_OF").collect()] == [("100000000000000005", "Hyades")]
    assert {tuple(r) for r in store.read_edges(spark, path).where("rel <> 'MEMBER_OF'").collect()} == others


def test_factors_join_to_the_pairs_two_edges_away(spark):
    r = random.Random(3)
    rows = {("Star", f"s{r.randrange(40)}", "MEMBER_OF", "Cluster", f"c{r.randrange(4)}") for _ in range(80)} | {("Star", f"s{r.randrange(40)}", "NEAR", "Star", f"s{r.randrange(40)}") for _ in range(20)}
    rows = {x for x in rows if x[1] != x[4]}
    edges = spark.createDataFrame(sorted(rows), "src_type string, src string, rel string, dst_type string, dst string")
    stars = spark.createDataFrame([(f"s{i}", float(i)) for i in range(40)], "source_id string, phot_g_mean_mag double")
    ids = stars.where("source_id LIKE 's1%'")
    left, right = graph.related_factors(edges, ids)
    assert left.count() + right.count() <= 4 * len(rows)
    want = {(x.source_id, x.related_id) for x in graph.related_stars(edges, stars, ids, 2, None).where("hops = 2").collect()}
    assert {(x.source_id, x.related_id) for x in left.join(right, "hub").where("source_id <> related_id").collect()} == want
