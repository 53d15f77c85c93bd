import math
import random

import pytest

from starloom.operators import crossmatch, tiles
from starloom.operators.aggregates import density_anomaly
from tests.test_sky_join import apart, field


def around(rows, radii):
    known = [r for r in rows if None not in r[1:]]
    found = {}
    for a in known:
        away = [apart(a, b) for b in known]
        n = [sum(x <= r for x in away) for r in radii]
        found[a[0]] = tuple(x + y for x, y in zip(found.get(a[0], (0,) * len(radii)), n, strict=True))
    return found


@pytest.mark.parametrize("radius", [0.1, 2.0, 15.0])
@pytest.mark.parametrize("full", [40, 400_000])
def test_counts_in_tiles_equal_brute_force(spark, monkeypatch, radius, full):
    """At the poles, around the wrap, in one dense field; with tiles too full for a task and without."""
    monkeypatch.setattr(crossmatch, "CROWDED", 0)
    monkeypatch.setattr(crossmatch, "FULL_TILE", full)
    rows = [*field(200, 5), ("twin", 10.0, 10.0), ("twin", 10.0, 10.0 + radius / 2)]
    df = spark.createDataFrame([*rows, ("nan", float("nan"), 1.0)], "source_id string, ra double, dec double")
    radii = [radius / 4, radius]
    assert {r.source_id: (r.n0, r.n1) for r in crossmatch.counts_in_radii(df, radii).collect()} == around(rows, radii)


def test_pairs_at_the_radius_are_told_by_the_separation_itself(spark, monkeypatch):
    """Stars on a grid lie exactly a radius apart; the join of pairs and the tiles agree on every one."""
    rows = [(f"{i}-{j}", 20 + i / 10, j / 10) for i in range(-9, 10) for j in range(-9, 10)]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    joined = {r.source_id: (r.n0, r.n1) for r in crossmatch.counts_in_radii(df, [0.1, 0.5]).collect()}
    monkeypatch.setattr(crossmatch, "CROWDED", 0)
    assert {r.source_id: (r.n0, r.n1) for r in crossmatch.counts_in_radii(df, [0.1, 0.5]).collect()} == joined


def test_an_even_sky_makes_no_pairs_of_cells(spark, monkeypatch):
    """Stars all over a wide field were counted by a pyramid of cells, 4,000 pairs of them a square degree and more, however many stars."""
    r = random.Random(9)
    rows = [(f"s{i}", r.uniform(100, 106), r.uniform(-3, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    assert crossmatch.crowding(df, 1.0) > crossmatch.CROWDED
    monkeypatch.setattr(crossmatch, "counts_within", lambda *a: pytest.fail("counted by cells"))
    found = {x.source_id: (x.n_small, x.n_large) for x in density_anomaly(df).collect()}
    some = rows[::60]
    assert {a[0]: found[a[0]] for a in some} == {a[0]: tuple(sum(apart(a, b) <= s for b in rows) for s in (0.1, 1.0)) for a in some}


def test_the_rim_alone_is_looked_into(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    e, d = r.uniform(-2, 2, 20_000), r.uniform(-2, 2, 20_000)
    seen, ranges = [], tiles._ranges
    monkeypatch.setattr(tiles, "_ranges", lambda a, b: seen.append(int(np.maximum(b - a, 0).sum())) or ranges(a, b))
    n, _, _ = tiles.counts(e, d, e, d, 1.0)
    assert sum(seen) < n.sum() / 10
    at = math.radians(1.0)
    assert abs(n[np.hypot(e, d) < 0.9].mean() / (20_000 / 16 * 2 * math.pi * (1 - math.cos(at)) / at**2) - 1) < 0.05


@pytest.mark.parametrize("full", [30, 400_000])
def test_context_in_tiles_equals_the_joined_pairs(spark, monkeypatch, full):
    """Ids that repeat, at one place and at two, a null id, and neighbours exactly a radius away."""
    monkeypatch.setattr(crossmatch, "FULL_TILE", full)
    r = random.Random(3)
    names = ["GAIA", "wise ", None, "", "2MASS", "gaia"]
    rows = [(*x, r.choice(names)) for x in field(120, 4)]
    rows += [(f"g{i}-{j}", 40 + i / 10, j / 10, names[(i + j) % 6]) for i in range(6) for j in range(6)]
    rows += [("twin", 10.0, 10.0, "WISE"), ("twin", 10.0, 10.0, "GAIA"), ("twin", 10.05, 10.0, None), ("twin", 10.0, 10.1, "GAIA"), ("alone", 10.01, 10.0, "2MASS"), (None, 10.0, 10.0, "X"), ("far", -5.0, 9.0, "X")]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double, catalog_source string")
    found = lambda out: sorted((str(x.source_id), x.catalog_source or "", x.ra or 0, x.local_density, tuple(x.matched_catalogs)) for x in out.collect())
    joined = found(crossmatch.neighbour_context(df, df.select("*"), 0.1))
    assert found(crossmatch.neighbour_context(df, df, 0.1)) == joined


def test_context_makes_no_row_for_each_pair(spark, monkeypatch):
    rows = [(f"s{i}", 10 + i % 40 / 400, 10 + i // 40 / 400, "GAIA" if i % 3 else "WISE") for i in range(1600)]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double, catalog_source string")
    monkeypatch.setattr(crossmatch, "sky_join", lambda *a, **k: pytest.fail("pairs were joined"))
    assert crossmatch.neighbour_context(df, df).agg({"local_density": "sum"}).first()[0] > 1_000_000
