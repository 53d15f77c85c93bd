"""Pairs that many rows share: made where they meet, told apart without a shuffle of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import graph, vectors


def test_bucketed_search_gives_what_the_bucket_join_gives_without_joining(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # copies
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.where("id % 20 = 5").selectExpr("id AS query_id", "vector AS query")
    got = vectors.vector_topk_lsh(v, q, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    unit = lambda c: array_to_vector(F.transform(c, lambda x: F.try_divide(x.cast("double"), F.sqrt(vectors.dot(c, c)))))
    data, asked = v.withColumn("_v", unit("vector")), q.withColumn("_v", unit("query"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=1.0, numHashTables=6, seed=42).fit(data)
    near = {}
    for x in model.approxSimilarityJoin(data, asked, 1.6, "d").selectExpr("datasetB.query_id q", "datasetA.id i", "1 - pow(d, 2) / 2 s").collect():
        near.setdefault(x.q, []).append((-x.s, x.i))
    want = {(a, i, -s) for a, found in near.items() for s, i in sorted(found)[:7]}
    assert {(x.query_id, x.id, x.score) for x in got.collect()} == want
    odd = spark.createDataFrame([(7, [0.0] * 8), (8, None)], "id long, vector array<float>")
    assert vectors.vector_topk_lsh(v.union(odd), q, 7).where("id IN (7, 8)").count() <= 20  # no error


def _edges(spark, seed):
    r = random.Random(seed)
    rows = {("Star", f"s{r.randrange(40)}", "MEMBER_OF", "Cluster", f"c{r.randrange(3)}") for _ in range(70)}
    rows |= {("Star", f"s{r.randrange(40)}", "MENTIONED_IN", "Paper", f"p{r.randrange(25)}") for _ in range(50)}
    rows |= {("Paper", f"p{r.randrange(25)}", "COVERS", "Cluster", f"c{r.randrange(3)}") for _ in range(40)}
    return rows, spark.createDataFrame(sorted(rows), "src_type string, src string, rel string, dst_type string, dst string")


@pytest.mark.parametrize("seed", [1, 2])
def test_papers_of_clusters_once_a_pair_and_no_window_over_pairs(spark, seed):
    rows, edges = _edges(spark, seed)
    papers = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(25)], "arxiv_id string, title string")
    ids = spark.createDataFrame([(f"s{i}",) for i in range(0, 40, 2)], "source_id string")
    asked = {f"s{i}" for i in range(0, 40, 2)}
    rel = lambda n: {(a, b) for _, a, x, _, b in rows if x == n}
    direct = {(s, p) for s, p in rel("MENTIONED_IN") if s in asked}
    around = {(s, p) for s, c in rel("MEMBER_OF") if s in asked for p, d in rel("COVERS") if c == d}
    found = graph.papers_of_star(edges, papers, ids, cluster_context=True)
    want = sorted([(*x, "direct") for x in direct] + [(*x, "cluster_context") for x in around - direct])
    assert sorted((x.source_id, x.arxiv_id, x.link_type) for x in found.collect()) == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_stars_two_edges_away_without_paths(spark):
    rows, edges = _edges(spark, 3)
    rows |= {("Star", "s1", "NEAR", "Star", "s2"), ("Star", "s2", "NEAR", "Star", "s2"), ("Star", "s2", "NEAR", "Star", "s3")}
    edges = spark.createDataFrame(sorted(rows), edges.schema)
    stars = spark.createDataFrame([(f"s{i}", float(i)) for i in range(40)], "source_id string, phot_g_mean_mag double")
    ends = {((a, b), (c, d)) for a, b, _, c, d in rows} | {((c, d), (a, b)) for a, b, _, c, d in rows}
    star = lambda n: n[0] == "Star"
    want = {(u[1], v[1], 1) for u, v in ends if star(u) and star(v) and u != v}
    want |= {(u[1], w[1], 2) for u, v in ends for x, w in ends if v == x and star(u) and star(w) and u != w}
    found = graph.related_stars(edges, stars, stars.select("source_id"), 2, None)
    got = [(x.source_id, x.related_id, x.hops) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "array_append" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 37, 100, 250, 400])
def test_a_large_limit_takes_ranges_and_the_same_rows(spark, monkeypatch, n):
    from starloom.operators import documents

    df = spark.range(250).selectExpr("id % 7 AS q", "id AS k").repartition(5)
    monkeypatch.setattr(documents, "FEW_ROWS", -1)
    got = [tuple(x) for x in documents.first_rows(df, ["q", "k"], n).collect()]
    assert sorted(got) == sorted((i % 7, i) for i in range(250))[:n]


def test_no_window_takes_all_papers_at_once(spark, sf_dir):
    from starloom.queries.more import corpus_build

    plan = corpus_build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan  # numbering all papers took them through one task
