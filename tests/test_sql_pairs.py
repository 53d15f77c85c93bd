import random

import pytest

from starloom.functions.sql import register_table_functions
from tests.test_sky_join import apart, sky


@pytest.mark.parametrize("radius", [0.02, 3.0])
def test_sql_pairs_equal_brute_force_and_no_side_is_broadcast(spark, radius):
    r = random.Random(1)
    rows = sky(120, 4) + [(f"c{i}", (r.uniform(-3, 3) * radius) % 360, max(-90.0, min(90.0, at + r.uniform(-3, 3) * radius))) for at in (0.0, 60.0, -89.9) for i in range(30)]
    view = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("parallax", "pmra", "pmdec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "ruwe"))
    stars = spark.createDataFrame(rows, "source_id string, ra double, dec double").selectExpr("*", view.split(", ")[0], *view.split(", ")[1:], "'GAIA' AS catalog_source", "'' AS object_class", "0 AS is_transient")
    register_table_functions(spark, stars)
    found = spark.sql(f"SELECT source_id, source_id_b FROM sky_pairs({radius}D)")
    known = [x for x in rows if None not in x]
    want = sorted((a[0], b[0]) for a in known for b in known if apart(a, b) <= radius)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
