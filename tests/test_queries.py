import pytest
from oracle import assert_same

from starloom import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_every_name_of_a_large_table_is_looked_for(spark):
    from starloom.operators import hybrid

    n = 1500
    stars = spark.range(n).selectExpr("CAST(id AS STRING) AS source_id", "id * 0.2D AS ra", "CAST(10.0 AS DOUBLE) AS dec")
    authority = spark.range(n).selectExpr("concat('Old Star ', id) AS name", "id * 0.2D AS ra", "CAST(10.0 AS DOUBLE) AS dec")
    papers = spark.range(n).selectExpr("CAST(id AS STRING) AS arxiv_id", "concat('We saw the old star ', id, ', and others.') AS abstract")
    assert {tuple(r) for r in hybrid.resolve_entities(papers, stars, authority).collect()} == {(str(i), str(i)) for i in range(n)}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_recall_of_the_approximate_search(spark):
    """At least 0.9 of the exact search's neighbours, over the whole query set of the next size."""
    from starloom.functions.tables import table
    from starloom.operators import vectors

    v = table(spark, "/root/testdata/sf0.01", "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    q = v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    near = lambda found: {(r.query_id, r.id) for r in found.select("query_id", "id").collect()}
    exact, approximate = near(vectors.vector_topk(v, q, 10)), near(vectors.vector_topk_lsh(v, q, 10))
    assert len(exact & approximate) >= 0.9 * len(exact)


def test_papers_are_whole_and_their_ids_unique(spark):
    from starloom.plans import fixtures

    docs = spark.createDataFrame([(10000, "a" * 5000), (100000, "b" * 2000 + " Gaia DR3 100000000000000007 "), (7, None)], "doc_id long, text string").selectExpr("*", "'s' AS source")
    p = {r.arxiv_id: r.abstract for r in spark.sql(fixtures.PAPERS, documents=docs).collect()}
    assert len(p) == 3 and len(p["2305.10000"]) > 5000 and "100000000000000007" in p["2305.100000"]


def test_limited_paths_equal_the_first_of_all(spark):
    import random

    from starloom.operators import graph

    r = random.Random(9)
    stars = spark.createDataFrame([(f"s{i}", r.choice([None, float(r.randrange(6))])) for i in range(60)], "source_id string, phot_g_mean_mag double")
    rows = [("Star", f"s{r.randrange(60)}", "MEMBER_OF", "Cluster", f"c{r.randrange(4)}") for _ in range(90)] + [("Star", f"s{r.randrange(70)}", "NEAR", "Star", f"s{r.randrange(70)}") for _ in range(25)]
    edges = spark.createDataFrame(rows, "src_type string, src string, rel string, dst_type string, dst string").distinct()
    ids = stars.where("source_id LIKE 's1%'").select("source_id")
    for hops in (1, 2, 3):
        everything = {}
        for x in graph.related_stars(edges, stars, ids, hops, None).collect():
            everything.setdefault(x.source_id, []).append((x.hops, x.phot_g_mean_mag is None, x.phot_g_mean_mag or 0, x.related_id))
        got = {}
        for x in graph.related_stars(edges, stars, ids, hops, 5).collect():
            got.setdefault(x.source_id, set()).add((x.hops, x.related_id))
        assert got == {s: {(v[0], v[3]) for v in sorted(found)[:5]} for s, found in everything.items()}


def test_terms_of_any_number_and_with_blanks(spark, monkeypatch):
    from starloom.operators import documents

    texts = ["a note on SN 2024a and others", "sn 2024ab", "", None, "x" * 30000 + " at7", "\U0001f600 AT7 \u00e9t\u00e9"]
    papers = spark.createDataFrame([(str(i), "A title", t, "cat") for i, t in enumerate(texts)], "arxiv_id string, title string, abstract string, categories string")
    alerts = spark.createDataFrame([(n,) for n in ("SN 2024a", "AT7", "", "\u00c9T\u00c9", None, "title\na", "SN 2024a")], "name string")
    assert {tuple(x) for x in documents.link_alerts_papers(alerts, papers).collect()} == {("SN 2024a", "0"), ("SN 2024a", "1"), ("AT7", "4"), ("AT7", "5"), ("\u00c9T\u00c9", "5")}
    regions = spark.createDataFrame([("SN 2024",), ("Note On",), ("Absent",)], "name string")
    few = {tuple(x) for x in documents.link_papers_clusters(papers, regions).collect()}
    monkeypatch.setattr(documents, "FEW_TERMS", 1)
    assert few and {tuple(x) for x in documents.link_papers_clusters(papers, regions).collect()} == few
    assert documents.texts_with_terms(papers.withColumnRenamed("abstract", "body"), alerts.limit(0).withColumnRenamed("name", "term")).count() == 0
