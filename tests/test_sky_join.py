import math
import random

import pytest

from starloom.operators import crossmatch
from starloom.operators.crossmatch import sky_join
from starloom.plans.fixtures import stars


def apart(a, b):
    d1, d2 = math.radians(a[2]), math.radians(b[2])
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def sky(n, seed):
    r = random.Random(seed)
    rows = [(f"s{i}", r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(n)]
    rows += [(f"p{i}", r.uniform(0, 360), s * r.uniform(88, 90)) for i in range(n // 8) for s in (-1, 1)]
    rows += [(f"w{i}", r.choice([r.uniform(0, 1), r.uniform(359, 360)]), r.uniform(-60, 60)) for i in range(n // 4)]
    return rows + [("pole", 0.0, 90.0), ("south", 10.0, -90.0), ("zero", 0.0, 0.0), ("n1", None, 1.0), ("n2", 1.0, None)]


@pytest.mark.parametrize("radius", [0.4, 3.0, 30.0])
def test_pairs_equal_brute_force_at_poles_and_wrap(spark, radius):
    rows = sky(160, 7)
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    known = [r for r in rows if None not in r]
    want = {(a[0], b[0]) for a in known for b in known if apart(a, b) <= radius}
    got = {(r.source_id, r.source_id_b) for r in sky_join(df, df, radius).collect()}
    assert got == want


def test_semi_anti_and_left(spark):
    a = spark.createDataFrame([("x", 10.0, 10.0), ("y", 50.0, 10.0), ("n", None, 10.0)], "source_id string, ra double, dec double")
    b = spark.createDataFrame([("b", 10.01, 10.0)], "source_id string, ra double, dec double")
    ids = lambda how: sorted(r.source_id for r in sky_join(a, b, 0.1, how).collect())
    assert ids("semi") == ["x"] and ids("anti") == ["n", "y"] and ids("left") == ["n", "x", "y"]


def test_plan_is_an_equi_join(spark, sf_dir):
    s = stars(spark, sf_dir).select("source_id", "ra", "dec")
    plan = sky_join(s, s, 0.08)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_empty_tables(spark):
    e = spark.createDataFrame([], "source_id string, ra double, dec double")
    assert sky_join(e, e, 1.0).count() == 0


def test_many_regions_go_by_cells_and_find_the_same(spark, monkeypatch):
    rows = sky(120, 3)
    points = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    r = random.Random(5)
    areas = [(f"r{i}", r.uniform(0, 360), r.uniform(-90, 90), r.choice([0.0, 0.3, 2.0, 5.5, 40.0, 100.0, -1.0])) for i in range(60)] + [("none", 1.0, 1.0, None), ("nowhere", None, 1.0, 9.0)]
    regions = spark.createDataFrame(areas, "name string, ra double, dec double, radius_deg double")
    known = [p for p in rows if None not in p]
    want = {(p[0], a[0]) for p in known for a in areas if None not in a and apart(p, a) <= a[3]}
    few = crossmatch.region_members(points, regions)
    labels = {tuple(x) for x in crossmatch.nearest_region(points, regions).select("source_id", "label").collect()}
    monkeypatch.setattr(crossmatch, "BROADCAST_ROWS", 3)
    many = crossmatch.region_members(points, regions)
    assert many.columns == few.columns
    for found in (few, many):
        pairs = [(x.source_id, x.region) for x in found.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {tuple(x) for x in crossmatch.nearest_region(points, regions).select("source_id", "label").collect()} == labels
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def field(n, seed, size=0.5):
    """Most stars in one small field, the others all over."""
    r = random.Random(seed)
    rows = [(f"f{i}", (359.9 + r.uniform(0, size)) % 360, 20 + r.uniform(0, size)) for i in range(n)]
    rows += [(f"g{i}", 100.0, -30.0) for i in range(n // 8)]  # one place
    return [(f"{i}{r[0]}", *r[1:]) for i, r in enumerate(rows + sky(n // 6, seed))]


@pytest.mark.parametrize("radius", [0.05, 0.3, 2.0])
def test_split_cells_lose_no_pair(spark, monkeypatch, radius):
    monkeypatch.setattr(crossmatch, "HOT_ROWS", 8)
    rows = field(240, 11)
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    known = [r for r in rows if None not in r]
    want = {(a[0], b[0]) for a in known for b in known if apart(a, b) <= radius}
    got = [(r.source_id, r.source_id_b) for r in sky_join(df, df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("radius", [0.05, 0.4, 3.0, 40.0])
@pytest.mark.parametrize("few", [0, 64])
def test_counts_of_the_pyramid_equal_brute_force(spark, monkeypatch, radius, few):
    monkeypatch.setattr(crossmatch, "FEW_PAIRS", few)
    rows = field(300, 12)
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "row long, ra double, dec double")
    known = [(i, r[1], r[2]) for i, r in enumerate(rows) if None not in r]
    want = {a[0]: sum(apart(a, b) <= radius for b in known) for a in known}
    assert {r.row: r.n for r in crossmatch.counts_within(df, df, radius).collect()} == want


def test_a_crowded_field_is_counted_by_cells(spark, monkeypatch):
    """The same densities both ways; no row for each pair of the field."""
    from starloom.operators.aggregates import density_anomaly

    rows = [(f"d{i}", 10 + 0.3 * random.Random(i).random(), 10 + 0.3 * random.Random(-i).random()) for i in range(1, 3000)] + field(60, 3)
    df = spark.createDataFrame([*rows, rows[5], (None, 10.1, 10.1)], "source_id string, ra double, dec double")
    assert crossmatch.crowding(df, 1.0) > crossmatch.CROWDED
    found = {r.source_id: tuple(r) for r in density_anomaly(df).collect()}
    monkeypatch.setattr(crossmatch, "CROWDED", 1e12)
    assert found == {r.source_id: tuple(r) for r in density_anomaly(df).collect()}


def test_a_dense_field_costs_about_what_the_same_stars_cost_spread_out(spark):
    """500,000 stars in a field of 0.1 degrees, and over the sky; neighbours within an arc-second."""
    import time

    n, radius = 500_000, 1 / 3600
    spread = spark.range(n).selectExpr("id AS source_id", "rand(1) * 360 AS ra", "degrees(asin(rand(2) * 2 - 1)) AS dec").cache()
    dense = spark.range(n).selectExpr("id AS source_id", "50 + rand(1) * 0.1 AS ra", "10 + rand(2) * 0.1 AS dec").cache()
    took = {}
    for name, stars_ in (("warm", spread), ("spread", spread), ("dense", dense)):
        stars_.count()
        begin = time.time()
        pairs = sky_join(stars_, stars_, radius).where("source_id <> source_id_b").count()
        took[name] = time.time() - begin
    assert pairs > n and took["dense"] <= 2 * took["spread"] + 1
    spread.unpersist(), dense.unpersist()


def test_no_side_is_broadcast_and_rows_are_copied_to_the_cells_within_the_radius(spark, sf_dir):
    s = stars(spark, sf_dir).select("source_id", "ra", "dec")
    for radius in (0.08, 3.0 / 3600):
        plan = sky_join(s, s, radius)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    known = s.where("ra IS NOT NULL").count()
    copies = crossmatch._placed(s, crossmatch.JOIN_ZONE * 0.08, True, 0.08).count()
    assert copies < 5 * known  # nine times as many before


@pytest.mark.parametrize("radius", [0.0008, 0.02, 0.11])
def test_small_radii_equal_brute_force_across_cells_of_any_size(spark, radius):
    r = random.Random(11)
    rows = []
    for i, (ra, dec) in enumerate([(0.0, 0.0), (359.99995, 30.0), (120.0, 89.9), (10.0, -89.97), (77.0, 60.0001)]):
        rows += [(f"k{i}-{j}", (ra + r.uniform(-2, 2) * radius / math.cos(math.radians(dec))) % 360, max(-90.0, min(90.0, dec + r.uniform(-2, 2) * radius))) for j in range(40)]
    df = spark.createDataFrame(rows, "source_id string, ra double, dec double")
    want = {(a[0], b[0]) for a in rows for b in rows if apart(a, b) <= radius}
    assert {(x.source_id, x.source_id_b) for x in sky_join(df, df, radius).collect()} == want


def test_matches_of_catalogs_copy_a_row_to_two_cells_and_a_quarter(spark, monkeypatch):
    r = random.Random(8)
    names = ["GAIA", "WISE", "2MASS", None]
    rows = [(str(i), r.uniform(0, 4), r.uniform(-2, 2), names[i % 4]) for i in range(1500)]
    stars = spark.createDataFrame(rows, "source_id string, ra double, dec double, catalog_source string")
    copies, placed = [], crossmatch._placed

    def seen(df, height, spread, radius):
        out = placed(df, height, spread, radius)
        if spread:
            copies.append(out.count() / 1500)
        return out

    monkeypatch.setattr(crossmatch, "_placed", seen)
    near = [(a, b) for a in rows for b in rows if a[3] != b[3] and abs(a[2] - b[2]) <= 0.03 and apart(a, b) <= 0.03]
    met = {a[0] for a, _ in near}
    alone = {n or "UNKNOWN": sum(x[3] == n and x[0] not in met for x in rows) for n in names}
    assert {x.catalog: x.unique_count for x in crossmatch.catalog_unique(stars, 108.0).collect()} == alone
    found = {(x.c1, x.c2): x.matches for x in crossmatch.catalog_overlap(stars, 108.0).collect()}
    for c1, c2 in found:
        assert found[c1, c2] == len({a[0] for a, b in near if (a[3] or "UNKNOWN", b[3] or "UNKNOWN") == (c1, c2)})
    assert len(copies) == 2 and max(copies) < 2.6
