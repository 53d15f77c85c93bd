"""Inverted indexes: terms in texts, and vectors by cells, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions.tables import table
from starloom.operators import documents, ivf, vectors
from starloom.plans.fixtures import papers
from starloom.queries.more import _NAMES


def test_terms_that_share_their_beginning(spark):
    """Every text has the common beginning, so only rarer grams may key a term."""
    r = random.Random(4)
    names = [f"gaia dr3 1000000000000{r.randrange(10**5):05d}" for _ in range(300)] + ["gaia dr3", "dr3", "x", "absent name", "gaia dr3 "]
    texts = [f"gaia dr3 sources such as {' and '.join(r.choice(names) for _ in range(3))} " * r.randint(1, 3) for _ in range(1000)] + ["", None, "x" * 50_000, "gaia dr3 "]
    body = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, texts[0])], "n long, body string")
    terms = spark.createDataFrame([(t,) for t in [*names, "", None]], "term string")
    want = sorted({(i, t) for i, x in [*enumerate(texts), (9999, texts[0])] for t in names if x and t in x})
    got = documents.texts_with_terms(body, terms.distinct())
    assert set(got.columns) == {"n", "body", "term"} and sorted({(x.n, x.term) for x in got.collect()}) == want
    keyed = body.where("body IS NOT NULL").select(F.xxhash64("body").alias("text_key"), "body")
    distinct_terms = terms.where("term <> ''").distinct()
    for x in documents.term_candidates(keyed, distinct_terms).select("term", "gram", "held_by").distinct().collect():
        others = [x.term[i : i + 8] for i in range(max(1, len(x.term) - 7))]
        held = min(sum(g in t for t in {t for t in texts if t}) for g in others)
        assert x.held_by == held  # its rarest gram


def test_candidates_of_the_larger_table_are_few(spark):
    sf = "/root/testdata/sf0.1"
    text = papers(spark, sf).select(F.lower("abstract").alias("body")).where("body IS NOT NULL").withColumn("text_key", F.xxhash64("body"))
    terms = spark.sql(_NAMES, events=table(spark, sf, "events")).select(F.lower("name").alias("term")).distinct()
    candidates = documents.term_candidates(text, terms).cache()
    matches = candidates.join(text, "text_key").where("contains(body, term)").select("text_key", "term").distinct().count()
    assert 0 < matches and candidates.count() <= 20 * matches
    n = text.count()
    grams = candidates.where(F.col("held_by") > 0.01 * n).select("term", "held_by").distinct().collect()
    for x in grams[:1]:  # a gram that many hold keys a term only if it has no rarer one
        held = text.select([F.count_if(F.contains("body", F.lit(x.term[i : i + 8]))).alias(f"g{i}") for i in range(len(x.term) - 7)]).first()
        assert min(held) >= x.held_by


def exact(rows, asked, k, threshold=None):
    out = set()
    for q_id, q in asked:
        scored = []
        for i, v in rows:
            if v is None or len(v) != len(q) or any(x is None or not np.isfinite(x) for x in v) or not np.any(v) or not np.any(q):
                continue
            s = float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q))
            if threshold is None or s >= threshold:
                scored.append((-round(s, 9), i))
        out |= {(q_id, i) for _, i in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "hot"])
def test_block_search_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 2000)
    g = np.random.default_rng(1)
    x = g.normal(size=(900, 5))
    if kind == "clusters":
        x = (g.normal(size=(12, 5)) * 30)[g.integers(0, 12, 900)] + g.normal(size=(900, 5))
    if kind == "hot":
        x[:400] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(2000, None), (2001, [0.0] * 5), (2002, [1.0, 2.0]), (2003, [None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 5), (2005, [])]
    asked = [(f"q{i}", v) for i, v in rows if i % 20 == 0]
    v = spark.createDataFrame([(i, x, i % 3, "c") for i, x in rows], "id long, vector array<double>, label int, extra string")
    q = spark.createDataFrame(asked, "query_id string, query array<double>")
    got = vectors.vector_topk(v, q, 10)
    assert got.columns == ["query_id", "id", "label", "extra", "score", "rank"]
    asked = [(i, x) for i, x in asked if x]
    assert {(r.query_id, r.id) for r in got.collect()} == exact(rows, asked, 10)
    cut = {(r.query_id, r.id) for r in vectors.vector_topk(v, q, 10, threshold=0.6, filters={"label": 1}).collect()}
    assert cut == exact([(i, x) for i, x in rows if i % 3 == 1], asked, 10, 0.6)
    assert vectors.vector_topk(v.limit(0), q).count() == 0 == vectors.vector_topk(v, q.limit(0)).count()


def test_an_index_probes_few_pairs_of_clustered_vectors(spark, tmp_path):
    g = np.random.default_rng(2)
    x = (g.normal(size=(60, 16)) * 3)[g.integers(0, 60, 4000)] + g.normal(size=(4000, 16)) * 0.4
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vector array<double>")
    q = v.where("id % 20 = 0").selectExpr("id AS query_id", "vector AS query")
    path = ivf.build_index(v, str(tmp_path / "index"))
    nprobe, recall = ivf.tuned_nprobe(spark, path, q, 10, 0.9)
    cost = ivf.pairs_compared(spark, path, q, 10, nprobe)
    assert recall >= 0.9 and cost["coded"] <= 0.1 * cost["all"] and cost["exact"] <= 0.1 * cost["all"]


def test_an_index_is_brought_up_to_date(spark, tmp_path):
    g = np.random.default_rng(3)
    x = g.normal(size=(600, 8))
    rows = [(f"d{i}", r) for i, r in enumerate(x.tolist())]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    path = ivf.build_index(v.limit(400), str(tmp_path / "index"), cells=12)
    changed = [(f"d{i}", (-x[i]).tolist()) for i in range(0, 300, 7)]
    new = spark.createDataFrame(changed + rows[400:] + [("none", None), ("zero", [0.0] * 8), ("short", [1.0])], "id string, vector array<double>")
    assert vectors.index_documents(v.limit(400), new, path).count() == 603
    ivf.add_to_index(path, new)  # again: nothing changes
    now = dict(rows) | dict(changed)
    assert {r.id: list(r.vector) for r in spark.read.parquet(f"{path}/rows").collect()} == now
    asked = [(i, now[i]) for i in list(now)[::20]]
    got = ivf.search_index(spark, path, spark.createDataFrame(asked, "query_id string, query array<double>"), 10, 12, 20)
    assert {(r.query_id, r.id) for r in got.collect()} == exact(now.items(), asked, 10)
    with pytest.raises(ValueError):
        ivf.build_index(v.limit(0), str(tmp_path / "none"))


def test_texts_are_split_once_and_close_scores_are_told_apart(spark):
    papers = spark.createDataFrame([(f"{i}", f"word{i % 7} and word{i % 5} again") for i in range(40)], "id string, abstract string")
    kept = vectors.embed_text(papers, "abstract", 16, keep=["id"])
    assert kept.columns == ["id", "vector"] and "split" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, *r.vector) for r in kept.collect()} == {(r.id, *r.vector) for r in vectors.embed_text(papers, "abstract", 16).collect()}
    # Scores that single precision can't tell apart, and many equal ones.
    x = [(i, [1.0, 1e-5 * (i % 50) / 50]) for i in range(500)]
    v = spark.createDataFrame(x, "id long, vector array<double>").repartition(200)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, query array<double>")
    found = vectors.vector_topk(v, q, 12)
    assert sorted((r.query_id, r.rank, r.id) for r in found.collect()) == [(0, n + 1, i) for n, i in enumerate([*range(0, 500, 50), 1, 51])] + [(1, n + 1, i) for n, i in enumerate([*range(49, 500, 50), 48, 98])]
    assert f"Coalesce {vectors.SEARCH_TASKS * spark.sparkContext.defaultParallelism}" in found._jdf.queryExecution().executedPlan().toString()
