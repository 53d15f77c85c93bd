import re

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.functions.tables import table
from starloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_names_and_entry():
    import __spark_entry__ as entry

    assert {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES} == {str(i) for i in range(1, 14)}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_stages_take_effect(spark):
    """Each stage against its rule, on what its predecessor kept."""
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    columns, toxic = docs.columns, {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = stages["toxicity"](spark, docs, sf_dir).cache()
    left = {r.doc_id for r in step.collect()}
    gone = {r.doc_id for r in docs.collect()} - left
    # Some thirty toxic examples to learn from here.
    assert step.columns == columns and sum(toxic.get(i, 0) for i in gone) >= 0.7 * sum(toxic.values())
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.03 * len(toxic)
    kept = stages["MinHash near-dedup"](spark, step, sf_dir).cache()
    from test_documents_ops import brute_components

    assert {r.doc_id for r in kept.collect()} == {c[0] for c in brute_components([(r.doc_id, r.text) for r in step.collect()]) if c[3]}
    clean = stages["benchmark decontamination"](spark, kept, sf_dir).cache()
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, sf_dir, "benchmark").collect()]
    holds = lambda t: any(f" {i} " in f" {' '.join(re.findall(chr(92) + 'w+', (t or '').lower()))} " for i in items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect() if not holds(r.text)}
    mixed = stages["mixing sources to target weights"](spark, clean, sf_dir).cache()
    assert mixed.columns == columns and mixed.exceptAll(clean).count() == mixed.count() - mixed.distinct().count()
    out = stages["token-ID output"](spark, mixed, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed.collect())
    total = out.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total[0] == total[1]
