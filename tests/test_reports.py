"""Reports, names and clusters against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregates, crossmatch, hybrid, volume


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 400 + [1.0], list(range(1000)), [0.0] * 900 + [random.Random(1).random() for _ in range(900)], [float("nan"), None, 2.0, 4.0]])
@pytest.mark.parametrize("p", [0.0, 0.04, 0.5, 0.75, 1.0])
def test_percentiles_are_exact(spark, values, p):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "m double")
    kept = [v for v in values if v is not None and v == v]
    got = volume.exact_percentile(df, "m", p)
    assert got is None if not kept else got == pytest.approx(np.percentile(kept, 100 * p), abs=1e-12)


def test_percentile_widens_a_bracket_that_misses(spark, monkeypatch):
    """A sketch that is off by half the table is found out by the counts."""
    values = [float(i) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    sketch, calls = F.percentile_approx, []

    def poor(column, ends, accuracy):
        calls.append(ends)
        return sketch(column, [0.9, 0.95], accuracy) if len(calls) == 1 else sketch(column, ends, accuracy)

    monkeypatch.setattr(volume.F, "percentile_approx", poor)
    assert volume.exact_percentile(df, "m", 0.3) == pytest.approx(np.percentile(values, 30)) and len(calls) > 1


def lloyd(x, centres, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
        if np.array_equal(after, centres):
            break
        centres = after
    return ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1), centres


@pytest.mark.parametrize("seeding", ["farthest", "parallel"])
def test_clusters_equal_a_numpy_run_from_the_same_seeds(spark, monkeypatch, seeding):
    g = np.random.default_rng(4)
    place = (g.normal(size=(5, 3)) * 20)[g.integers(0, 5, 800)] + g.normal(size=(800, 3))
    move = g.normal(size=(800, 2)) * 30
    rows = [(str(i), *map(float, place[i]), *map(float, move[i])) for i in range(800)]
    df = spark.createDataFrame(rows, "source_id string, display_x_pc double, display_y_pc double, display_z_pc double, pmra double, pmdec double")
    x = np.column_stack([place, move / max(1.0, np.percentile(np.abs(move), 75)) * 0.18])
    seeds = []
    made = volume.parallel_seeds
    monkeypatch.setattr(volume, "parallel_seeds", lambda *a, **k: seeds.append(made(*a, **k)) or seeds[-1])
    got = {r.source_id: r.cluster for r in volume.kmeans3d(df, 5, 30, seeding).collect()}
    if seeding == "parallel":
        centres = np.array(seeds[0])
    else:
        centres = x[[int((x[:, :3] ** 2).sum(1).argmax())]]
        while len(centres) < 5:
            centres = np.vstack([centres, x[((x[:, None] - centres[None]) ** 2).sum(2).min(1).argmax()]])
    want, _ = lloyd(x, centres, 30)
    assert len(centres) == 5 and got == {str(i): int(c) for i, c in enumerate(want)}


SUFFIX = re.compile(r"(?<!\w)[ _-]?(?:[ABCabc][1-6]?|[IVX]+|[1-6])$")


def test_names_of_a_table_against_brute_force(spark):
    from starloom.functions.text import LOOSE

    names = ["sirius", "Vega", "alpha centauri", "HD 1-", "GJ 699+", "barnard's star", "sgr a*", "Vega"]
    texts = ["We saw HD 1- A and hd 1- a and Vega, vegas, VEGA!", "GJ 699+ B; sgr a* and Sgr A*b", "alpha   centauri, alpha centauri.", "Vega", "  Vega  ", None, "barnard's star near HIP 12 HIP 13 HR 1 HR 2 HR 3 HR 4 HR 5 HR 6 HR 7 HR 8 HR 9 HR 10 HR 11", "xSirius sirius-like"]
    papers = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "arxiv_id string, abstract string")
    got = {}
    for r in hybrid.star_names(papers, spark.createDataFrame([(n,) for n in names], "name string")).orderBy("arxiv_id", "place").collect():
        got.setdefault(r.arxiv_id, []).append(r.star)
    want = {}
    for i, t in enumerate(texts):
        if not t or len(t.strip()) < 8:
            continue
        found = []
        for p in LOOSE:
            for m in re.finditer(p, t, re.ASCII):
                raw = m.group(1).strip()
                short = SUFFIX.sub("", raw).strip()
                found += [raw, short] if short != raw and short in names else [raw]
        found += [n for n in sorted(set(names)) if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", t, re.IGNORECASE | re.ASCII)]
        once = list({n.lower(): n for n in reversed(found)}.values())
        first = [n for k, n in enumerate(found) if n.lower() not in {x.lower() for x in found[:k]}]
        assert len(once) == len(first)
        if first:
            want[str(i)] = first[:12]
    assert got == want


def test_reports_of_empty_and_odd_tables(spark):
    schema = "source_id string, ra double, dec double, catalog_source string"
    empty = spark.createDataFrame([], schema)
    assert [tuple(r) for r in crossmatch.overlap_report(empty).collect()] == [(0, 0, 0.0)]
    odd = spark.createDataFrame([("1", 1.0, 1.0, "A"), ("2", 1.0, 1.0, "B"), ("3", None, 1.0, "A"), ("4", 9.0, 9.0, None)], schema)
    assert [tuple(r) for r in crossmatch.overlap_report(odd).collect()] == [(4, 3, 0.75)]
    stats = aggregates.ingest_stats(odd).first()
    assert (stats.total, stats.catalogs, stats.by_catalog) == (4, 3, {"A": 2, "B": 1, "UNKNOWN": 1})
    typed = spark.createDataFrame([("x", "a", 3), ("y", " ", None), ("z", "a", None)], "name string, type string, star_count long")
    assert {r.type: (r.regions, r.stars, r.names) for r in aggregates.regions_by_type(typed).collect()} == {"a": (2, 3, ["x", "z"]), "UNKNOWN": (1, 0, ["y"])}
