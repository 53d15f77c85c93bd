"""Entities in texts: a text is searched once for each pattern, whatever is found in it."""

import pytest
from pyspark.sql import functions as F

from starloom.functions import text as tx

NAMES = ["Sirius", "Vega"]


@pytest.mark.parametrize(
    ("made", "piece", "most"),
    [
        (lambda: tx.catalog_ids("t"), "regexp_extract_all(", len(tx.STRICT)),
        (lambda: tx.star_names("t", NAMES), "regexp_extract_all(", len(tx.LOOSE)),
        (lambda: tx.gaia_ids_near("t"), "regexp_extract_all(", 4),
        (lambda: tx.gaia_ids_near("t"), "split(", 2),
        (lambda: tx.cluster_mentions("t"), "lower(", 1),
        (lambda: tx.cluster_mentions("t"), "instr(", sum(map(len, tx.CLUSTERS.values()))),
    ],
)
def test_a_pattern_is_searched_once_a_text(spark, made, piece, most):
    plan = spark.createDataFrame([("x",)], "t string").select(made().alias("found"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count(piece) <= most


def test_many_identifiers_and_mentions_in_one_text(spark):
    ids = [f"HD {i}" for i in range(300)]
    long = "Gaia " + " ".join(str(10**17 + i) for i in range(30))  # numbers of 18 digits, some beyond 200 characters of the mention
    df = spark.createDataFrame([(" ".join([*ids, *(x.lower().replace(" ", "") for x in ids)]) + " Vega sirius", long)], "t string, g string")
    row = df.select(tx.catalog_ids("t").alias("ids"), tx.star_names("t", NAMES, 400).alias("names"), tx.gaia_ids_near("g").alias("near"), tx.cluster_mentions(F.lit("Praesepe, m45; HYADES")).alias("c")).first()
    assert row.ids == ids and row.names == [*ids, *NAMES]
    assert row.near == [str(10**17 + i) for i in range(30) if 5 + 19 * i < 200] and row.c == ["praesepe", "pleiades", "hyades"]


def test_only_runs_of_wanted_characters_are_cut_from_texts(spark):
    from starloom.operators import documents

    terms = spark.createDataFrame([("gaia dr3 12[3]",), ("a-b\\^c]d",), ("\U0001f600x",), ("ab",)], "term string")
    texts = spark.createDataFrame([(0, "see gaia dr3 12[3] there"), (1, "gaia dr3 12(3)"), (2, "so a-b\\^c]d\nand \U0001f600xy"), (3, "nothing else, only prose"), (4, "c ab c")], "text_key int, body string")
    wanted = spark.createDataFrame([("gaia dr3",), ("a-b\\^c]d",)], "gram string")
    of = documents.characters(wanted)
    cut = {r.text_key: r.g for r in texts.select("text_key", documents.grams("body", [8], of).alias("g")).collect()}
    assert "gaia dr3" in cut[0] and "gaia dr3" in cut[1] and "a-b\\^c]d" in cut[2] and cut[3] == cut[4] == []
    assert all(len(g) == 8 and set(g) <= set("gaia dr3a-b\\^c]d") for gs in cut.values() for g in gs)
    assert documents.characters(wanted.limit(0)) == "."
    got = {(r.text_key, r.term) for r in documents.texts_with_terms(texts, terms).select("text_key", "term").collect()}
    assert got == {(0, "gaia dr3 12[3]"), (2, "a-b\\^c]d"), (2, "\U0001f600x"), (4, "ab")}
