"""Small inputs with known answers."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from starloom.functions import columns, sky, stellar
from starloom.functions import text as tx
from starloom.operators import aggregates, cone, discovery, documents, graph, metrics, sessions, upserts
from starloom.sources import catalogs, exports, feeds

SCHEMA = "source_id string, ra double, dec double, parallax double, parallax_error double, pmra double, pmra_error double, pmdec double, pmdec_error double, phot_g_mean_mag double, phot_bp_mean_mag double, phot_rp_mean_mag double, ruwe double, catalog_source string, object_class string, is_transient int, alert_name string"


def star(i, ra=10.0, dec=20.0, **k):
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")]) | {"source_id": str(i), "ra": ra, "dec": dec, "is_transient": 0} | k
    return tuple(row.values())


def one(df):
    return df.first()[0]


def test_finite_and_labels(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), ("Infinity",), (None,)], "x string")
    assert [r[0] for r in df.select(columns.finite("x")).collect()] == [1.5, None, None, None, None]
    cls = spark.createDataFrame([("yso/young_star",), ("  ",), (None,)], "x string").select(columns.normalize_object_class("x"))
    assert [r[0] for r in cls.collect()] == ["YSO YOUNG STAR", None, None]
    key = spark.createDataFrame([("wise", "7"), ("gaia", "7"), ("pan starrs", "PAN-STARRS:9"), ("2mass", " ")], "c string, k string").select(columns.prefix_source_id("c", "k"))
    assert [r[0] for r in key.collect()] == ["WISE:7", "7", "PAN-STARRS:9", "2MASS:unknown"]


def test_uuid5(spark):
    ids = ["2301.00001", "hep-th/9901001", ""]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x string").select(columns.uuid5_dns("x")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, i)) for i in ids]


def test_frames_and_time(spark):
    ra, dec = spark.range(1).select(*sky.galactic_to_icrs(0.0, 0.0)).first()
    assert abs(ra - 266.40499) < 1e-3 and abs(dec + 28.93617) < 1e-3
    t = datetime.datetime(2000, 1, 1, 12)
    df = spark.createDataFrame([(t,)], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    assert one(df.select(sky.mjd("t"))) == 51544.5
    assert one(df.select(sky.from_mjd(sky.mjd("t")) == F.col("t")))
    x = spark.range(1).select(*sky.to_cartesian(30.0, 40.0, 10.0)).toDF("x", "y", "z")
    assert [round(v, 9) for v in x.select(*sky.from_cartesian("x", "y", "z")).first()] == [30.0, 40.0, 10.0]
    zero = spark.range(1).select(*sky.from_cartesian(0.0, 0.0, 0.0)).first()
    assert list(zero) == [None, None, None]


def test_parameter_file(spark):
    df = spark.createDataFrame([star(1)], SCHEMA).withColumn("teff_estimated_k", F.lit(6400.0))
    text = one(exports.inlist_text(df).select("value"))
    assert "initial_mass = 1.15" in text and "initial_z = 0.0200" in text


def test_region_lines_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("A", 12.3, -4.5, 16.2), ("B", 13.0, -4.0, 9.0)], "source_id string, ra double, dec double, discovery_score double")
    lines = [r.value for r in exports.ds9_region_lines(df).collect()]
    assert "color=red" in lines[0] and "color=green" in lines[1]
    assert exports.crtf_region_lines(df).first().value.startswith("circle [[00:49:12.0000, -04.30.00.000], 5arcsec]")
    stars = spark.createDataFrame([star(1, phot_bp_mean_mag=12.5, phot_rp_mean_mag=11.25, parallax=float("nan"))], SCHEMA).withColumn("discovery_reasons", F.array(F.lit("a<b"), F.lit("c")))
    row = one(exports.votable_rows(stars).select("row"))
    assert "<TD>1.25</TD>" in row and "a&lt;b; c" in row and "NaN" not in row
    exports.export_csv(stars, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == exports.FIELDS and back.first()["discovery_reasons"] == "a<b; c"


def test_text_entities(spark):
    t = lambda s: spark.createDataFrame([(s,)], "t string")
    assert one(t("Candidate Gaia DR3 1234567890123456789 near the Pleiades field.").select(tx.gaia_ids("t"))) == ["1234567890123456789"]
    near = "Gaia saw 111111111111111111 and Gaia DR2 222222222222222222." + " x" * 200 + " 333333333333333333"
    assert one(t(near).select(tx.gaia_ids_near("t"))) == ["222222222222222222", "111111111111111111"]
    assert one(t("Sirius, HD 48915, and HIP 32349; hd48915").select(tx.catalog_ids("t"))) == ["HD 48915", "HIP 32349"]
    assert one(t("Pleiades (M45) and Hyades").select(tx.cluster_mentions("t"))) == ["pleiades", "hyades"]
    assert one(t("Sirius and HD 48915").select(tx.star_names("t", ["Sirius", "Vega"]))) == ["HD 48915", "Sirius"]
    assert one(t("arXiv:2301.00001v2").select(tx.arxiv_id("t", F.lit("f")))) == "2301.00001"
    asked = t("stars at ra=66.75 dec=-15.8").select(tx.route("t").alias("r")).first().r
    assert (asked.kind, asked.ra, asked.dec) == ("cone", 66.75, -15.8)


def test_chunks(spark):
    text = "a" * 899 + "." + "b" * 700
    rows = documents.chunk_text(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "arxiv_id string, abstract string")).collect()
    assert [len(r.chunk) for r in rows] == [900, 900] and {r.arxiv_id for r in rows} == {"p"}
    assert rows[0].chunk + rows[1].chunk[200:] == text


def test_dedupe_keeps_the_first(spark):
    rows = [star(i, phot_g_mean_mag=g) for i, g in ((1, 10.0), (2, 10.0), (3, 11.0))]
    got = cone.dedupe_measurements(spark.createDataFrame(rows, SCHEMA), "source_id")
    assert sorted(r.source_id for r in got.collect()) == ["1", "3"]


def test_ranking_prefers_the_cross_matched_anomaly(spark):
    rows = [
        star(1, ra=10.0, catalog_source="GAIA", ruwe=1.0, phot_g_mean_mag=12.0, phot_bp_mean_mag=12.5, phot_rp_mean_mag=11.5, parallax=5.0, pmra=1.0, pmdec=1.0),
        star(2, ra=10.01, catalog_source="WISE", ruwe=2.5, phot_g_mean_mag=14.0, pmra=90.0, pmdec=0.0),
        star(3, ra=10.02, catalog_source="2MASS", ruwe=1.0, phot_g_mean_mag=14.0),
    ]
    top = discovery.rank_discovery_candidates(spark.createDataFrame(rows, SCHEMA), limit=3).collect()
    assert top[0].source_id == "2" and top[0].matched_catalogs == ["2MASS", "GAIA"] and top[0].local_density == 2
    assert top[0].score == pytest.approx(8 + 16 + 3.5 + 14 + 0.2 + 4.0 + 1.0, abs=0.05) and len(top[0].reasons) == 4


def test_catalog_summary_labels(spark):
    df = spark.createDataFrame([(c,) for c in ("gaia", "GAIA", "wise", "", None)], "catalog_source string")
    assert {r.catalog: r.n for r in aggregates.catalog_summary(df, upper=True).collect()} == {"GAIA": 2, "UNKNOWN": 2, "WISE": 1}


def test_forbidden_words(spark):
    df = spark.createDataFrame([star(1)], SCHEMA)
    with pytest.raises(ValueError):
        cone.custom_where(df, "1 = 1; DROP TABLE stars")


def test_metrics_edges(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("e", 1, "z")], "query string, rank int, item string")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c")], "query string, item string")
    m = {r["query"]: r for r in metrics.ir_metrics(ranked, relevant, (1, 5)).collect()}
    assert (m["q"].mrr, m["q"].precision_5, m["q"].recall_5, m["q"].precision_1) == (0.5, 0.5, 0.5, 0.0)
    assert m["e"].recall_5 == 0 and m["e"].mrr == 0 and all(0 <= v <= 1 for v in m["q"][1:])


def test_two_hops(spark):
    edges = spark.createDataFrame([("Star", "1", "MENTIONED_IN", "Paper", "p"), ("Star", "2", "MENTIONED_IN", "Paper", "p")], "src_type string, src string, rel string, dst_type string, dst string")
    stars = spark.createDataFrame([star(1), star(2)], SCHEMA)
    got = graph.related_stars(edges, stars, stars.where("source_id = '1'"), 3).collect()
    assert [(r.related_id, r.hops) for r in got] == [("2", 2)]
    assert graph.add_edges(edges, edges).count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string").withColumn("n", F.length("v"))
    after = upserts.upsert(old, new.drop("n"), "k", "v")
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(map(tuple, upserts.upsert(after, after, "k", "v").collect())) == sorted(map(tuple, after.collect()))
    assert sorted(map(tuple, upserts.insert_ignore(old, new.drop("n").where("v <> 'd'"), "k").collect())) == [(1, "a"), (2, "b"), (3, "e")]
    s, m = upserts.delete_session(spark.createDataFrame([(1,), (2,)], "conv_id int"), spark.createDataFrame([(1, 0), (2, 0)], "conv_id int, turn int"), 1)
    assert s.count() == m.count() == 1


def test_catalog_files(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text(" Designation ,RA_deg,dec,w1mpro,extra\nJ1,10.5,abc,7.5,x\n,11.5,3.0,,y\n")
    rows = catalogs.read_catalog_csv(spark, str(p), "wise").collect()
    assert rows[0].source_id == "WISE:J1" and rows[0].dec is None and rows[0].phot_g_mean_mag == 7.5 and rows[1].source_id == "WISE:unknown"
    with pytest.raises(ValueError):
        catalogs.to_canonical(spark.createDataFrame([(1,)], "x int"), "GAIA")
    j = tmp_path / "c.jsonl"
    j.write_text('{"source_id": 5, "ra": 1.0, "dec": 2.0}\n')
    assert catalogs.read_catalog_json(spark, str(j), "gaia").first().source_id == "5"


def test_feeds(spark, tmp_path):
    (tmp_path / "tns.json").write_text('{"data": {"reply": [{"objname": "2024a", "radeg": "1.5", "decdeg": null, "object_type": {"name": "SN Ia"}, "discoverydate": "2024-01-01 00:00:00", "discoverymag": "17.5"}]}}')
    r = feeds.read_tns_json(spark, str(tmp_path / "tns.json")).first()
    assert (r.name, r.ra, r.dec, r.type, r.mag) == ("2024a", 1.5, None, "SN Ia", 17.5)
    (tmp_path / "al.json").write_text('{"items": [{"oid": "ZTF1", "meanra": 1.0, "meandec": 2.0, "class": null, "firstmjd": 51544.5, "first_magpsf_g": null, "first_magpsf_r": 18.0}]}')
    r = feeds.read_alerce_json(spark, str(tmp_path / "al.json")).first()
    assert (r.type, r.mag, r.ts) == ("unknown", 18.0, datetime.datetime(2000, 1, 1, 12))


def test_session_titles(spark):
    m = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "x" * 80), (2, 0, "user", "q")], "conv_id int, turn int, role string, content string")
    stored = spark.createDataFrame([(2, "kept"), (3, "other")], "conv_id int, title string")
    assert {r.conv_id: r.title for r in sessions.session_titles(m, stored).collect()} == {1: "x" * 50, 2: "kept", 3: "other"}


def test_sed_and_bands(spark):
    df = spark.createDataFrame([star(1, phot_g_mean_mag=10.0, phot_bp_mean_mag=10.5, phot_rp_mean_mag=9.5), star(2)], SCHEMA)
    s = df.withColumn("sed", stellar.sed(["phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"])).orderBy("source_id").select("sed", stellar.wien_teff("sed").alias("t")).collect()
    assert [p.wavelength_um for p in s[0].sed] == [0.532, 0.673, 0.797] and s[0].t == round(2898 / 0.797) and s[1].t is None


def test_catalogs_without_a_match_are_listed(spark):
    from starloom.operators import crossmatch

    rows = [star(1, 10.0, 20.0, catalog_source="GAIA"), star(2, 10.0, 20.0, catalog_source="WISE"), star(3, 200.0, -5.0, catalog_source="2MASS")]
    s = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.c1, r.c2, r.matches) for r in crossmatch.catalog_overlap(s).collect()) == [("2MASS", "GAIA", 0), ("2MASS", "WISE", 0), ("GAIA", "WISE", 1)]
    assert sorted(tuple(r) for r in crossmatch.catalog_unique(s).collect()) == [("2MASS", 1), ("GAIA", 0), ("WISE", 0)]


def test_work_folder_of_a_cluster_must_be_shared():
    from starloom.plans import durable

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Unset:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError):
        durable.work_dir(Session())
