"""Names of a table in texts: by runs of words as they stand, whatever the number of names."""

import re

import pytest

from starloom.operators import hybrid

NAMES = ["Gaia DR3 12", "Sirius", "foo-bar", "foo bar", "Sgr A*", "(odd)", "été clair", "x", "x y z", "A_b", "—", "", None, "two\nlines"]
TEXTS = ["gaia dr3 12 and GAIA DR3 123", "Foo-Bar foo  bar", "foo bar,sirius", "Sgr A* (odd) odd", "ÉTÉ clair été clair", "x y z", "ax y zb", "a_B xa_b", "Two\nLines two lines", "", None, "Sirius" * 3, "sgr a is not"]


@pytest.mark.parametrize(("broadcast", "firsts"), [(100, 100), (1, 100), (1, 2), (100, 2)])
def test_names_in_texts_are_those_of_brute_force(spark, monkeypatch, broadcast, firsts):
    monkeypatch.setattr(hybrid, "BROADCAST_NAMES", broadcast)
    monkeypatch.setattr(hybrid, "FEW_FIRSTS", firsts)
    papers = spark.createDataFrame(list(enumerate(TEXTS)), "arxiv_id long, abstract string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    whole = lambda n, t: re.search(r"(?<!\w)" + re.escape(n) + r"(?!\w)", t, re.IGNORECASE | re.ASCII)
    want = {(i, n) for i, t in enumerate(TEXTS) for n in NAMES if n and t and re.search(r"\w", n, re.ASCII) and whole(n, t)}
    found = hybrid.named_in_text(papers, names)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 10


def test_texts_are_not_joined_again_for_plain_names(spark, monkeypatch):
    """Of many names that begin alike, a run that begins otherwise meets none: no row of the texts is dealt out for it."""
    monkeypatch.setattr(hybrid, "BROADCAST_NAMES", 1)
    papers = spark.createDataFrame([(i, f"some words {i} and no star") for i in range(50)], "arxiv_id long, abstract string")
    names = spark.createDataFrame([(f"gaia dr3 {i}",) for i in range(500)], "name string")
    plan = hybrid.named_in_text(papers, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?:gaia)" in plan
