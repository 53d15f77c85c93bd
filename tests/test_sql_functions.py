"""SQL functions against the column functions, value by value, and functions that return tables."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.functions import columns, sky, stellar, text
from starloom.functions import sql as sf
from starloom.operators import cone, crossmatch, discovery, documents
from starloom.operators.profiles import profile


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    pick = lambda lo, hi: r.choice([None, 0.0, lo, hi, r.uniform(lo, hi), r.uniform(lo, hi), r.uniform(lo, hi)])
    limits = {"ra": (0, 360), "dec": (-90, 90), "ra2": (0, 360), "dec2": (-90, 90), "r": (0, 90), "parallax": (-1, 50), "parallax_error": (-0.1, 3), "pmra": (-200, 200), "pmra_error": (0, 9), "pmdec": (-200, 200), "pmdec_error": (0, 9), "ruwe": (0.5, 3), "phot_g_mean_mag": (-2, 20), "phot_bp_mean_mag": (-2, 20), "phot_rp_mean_mag": (-2, 20), "colour": (-0.5, 4), "m_g": (-5, 16), "teff": (2000, 20000), "score": (0, 40), "Jmag": (0, 15), "Hmag": (0, 15), "Kmag": (0, 15), "W1mag": (0, 15), "W2mag": (0, 15)}
    words = [None, "", "  ", "yso/young_star", " rr_lyrae ", "Gaia", "smc x", "LMC", "12.5", "nan", "-inf", "1e3", "arXiv:2301.12345 Abstract: short one.\n\nIntroduction", "A Title That Is Long Enough For This\nGaia DR3 123456789012345678 and Gaia 123456789012345678", "galactic", "arcmin"]
    data = [(i, r.choice(words), *(pick(float(a), float(b)) for a, b in limits.values())) for i in range(600)]
    made = spark.createDataFrame(data, "n long, word string, " + ", ".join(f"{c} double" for c in limits))
    return made.withColumn("t", F.timestamp_micros((F.col("n") * 86_399_123_457).cast("long"))).withColumn("catalog_source", F.col("word")).cache()


def test_scalars_equal_the_column_functions(spark, rows):
    sf.register_sql_functions(spark)
    c, g, bp, rp = F.col, "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag"
    mags = [g, bp, rp, "Jmag", "Hmag", "Kmag", "W1mag", "W2mag"]
    xyz, back = sky.to_cartesian("ra", "dec", "parallax"), sky.from_cartesian("parallax", "pmra", "pmdec")
    galactic, texts = sky.galactic_to_icrs("ra", "dec"), sky.sexagesimal("ra", "dec")
    pairs = {
        "as_finite(word)": columns.finite("word"), "object_class_of(word)": columns.normalize_object_class("word"), "catalog_of(word, 'GAIA')": columns.normalize_catalog("word"),
        "sky_sep(ra, dec, ra2, dec2)": sky.separation_deg("ra", "dec", "ra2", "dec2"), "in_cone(ra, dec, ra2, dec2, r)": sky.in_cone("ra", "dec", "ra2", "dec2", "r"), "radius_in_deg(r, 'arcmin')": c("r") / 60.0,
        "icrs_ra(ra, dec, 'Galactic ')": galactic[0], "icrs_dec(ra, dec, 'galactic')": galactic[1], "icrs_dec(ra, dec, 'fk5')": c("dec"),
        **{f"to_cartesian(ra, dec, parallax).{k}": v for k, v in zip("xyz", xyz, strict=True)}, **{f"from_cartesian(parallax, pmra, pmdec).{k}": v for k, v in zip(("ra", "dec", "distance"), back, strict=True)},
        "distance_pc(parallax)": sky.distance_pc("parallax"), "light_years(r)": sky.light_years("r"), f"bp_rp({bp}, {rp})": stellar.bp_rp(), "total_motion(pmra, pmdec)": stellar.total_motion(), f"absolute_mag({g}, parallax)": stellar.absolute_mag(),
        "absolute_mag_error(pmra_error, parallax, parallax_error)": stellar.absolute_mag_error("pmra_error"  , "parallax", "parallax_error"), "teff_error(pmra_error, pmdec_error)": stellar.teff_error("pmra_error", "pmdec_error"), "binary_separation(ruwe, parallax)": stellar.binary_separation(), "angular_size_pc(r, parallax)": stellar.angular_size_pc("r"),
        "population5(colour, m_g)": stellar.population5(c("colour"), c("m_g")), "population14(colour, m_g)": stellar.population14(c("colour"), c("m_g")), "teff_of(colour)": stellar.teff(c("colour")), "hr_mass(colour, m_g)": stellar.hr_mass(c("colour"), c("m_g")), "log_g_of(ruwe)": stellar.log_g(c("ruwe")), "metallicity_of(word)": stellar.metallicity("word"), "fallback_mass(teff, colour)": stellar.fallback_mass(c("teff"), c("colour")),
        f"physical_parameters({g}, {bp}, {rp}, parallax, pmra, pmdec, ruwe, word, teff)": stellar.physical_parameters(c("teff")), f"deredden({g}, {bp}, {rp}, ruwe)": stellar.deredden("ruwe"), "flux_jy(Jmag, 'Jmag')": stellar.flux_jy("Jmag", "Jmag"), f"sed({', '.join(mags)})": stellar.sed(mags), f"wien_teff(sed({', '.join(mags)}))": stellar.wien_teff(stellar.sed(mags)),
        "ra_text(ra)": texts[0], "dec_text(dec)": texts[1], "snr_penalty(pmra, pmra_error)": stellar.snr_penalty("pmra", "pmra_error"), f"confidence(score, {g}, parallax, parallax_error, pmra, pmra_error, pmdec, pmdec_error, ruwe)": stellar.confidence("score"), "mjd(t)": sky.mjd("t"), "from_mjd(mjd(t))": sky.from_mjd(sky.mjd("t")),
        "arxiv_id(word, 'f')": text.arxiv_id("word", F.lit("f")), "abstract_of(word)": text.extract_abstract("word"), "title_line(word)": text.title_line("word"), "gaia_ids(word)": text.gaia_ids("word"), "preview(word, 5)": text.preview("word", 5),
    }
    assert {f.split("(")[0] for f in pairs} | {"unit_of", "named_cluster", "sky_zone", "sky_cells", "sky_cell"} == set(sf.FUNCTIONS)
    both = rows.select("n", *(F.expr(f).alias(f"s{i}") for i, f in enumerate(pairs)), *(e.alias(f"c{i}") for i, e in enumerate(pairs.values())))
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and (abs(a - b) <= 1e-9 * max(1.0, abs(b)) or a != a != b)) or (isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)) and len(a) == len(b) and all(map(close, a, b)))
    wrong = {f: (x[f"s{i}"], x[f"c{i}"]) for x in both.collect() for i, f in enumerate(pairs) if not close(x[f"s{i}"], x[f"c{i}"])}
    assert not wrong


def test_functions_that_return_tables(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"s{i}", r.uniform(0, 360) if i % 3 else 10 + r.random() / 50, r.uniform(-90, 90) if i % 3 else 20 + r.random() / 50, 3.0, 0.1, 1.0, 0.1, 2.0, 0.1, r.uniform(3, 15), 9.0, 8.0, r.uniform(0.5, 3), r.choice(["GAIA", "WISE", None, " "]), None, 0) for i in range(600)]
    made = spark.createDataFrame(rows + [("n", None, 1.0, *rows[0][3:])], "source_id string, ra double, dec double, parallax double, parallax_error double, pmra double, pmra_error double, pmdec double, pmdec_error double, phot_g_mean_mag double, phot_bp_mean_mag double, phot_rp_mean_mag double, ruwe double, catalog_source string, object_class string, is_transient int")
    made.write.parquet(str(tmp_path / "stars"))
    stars = spark.read.parquet(str(tmp_path / "stars"))
    sf.register_table_functions(spark, stars)
    found = spark.sql("SELECT * FROM cone(10.01, 20.01, 0.3) WHERE phot_g_mean_mag < 12")
    near = cone.radial_search(stars, 10.01, 20.01, 0.3, mag_limit=11.999999, limit=1000)
    assert {x.source_id for x in found.collect()} == {x.source_id for x in near.collect()}
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "ThanOrEqual(dec,19.71" in scan.split("PushedFilters")[1] and "<= 20.31" in scan  # the band reaches the scan
    got = {(x.source_id, x.source_id_b) for x in spark.sql("SELECT * FROM sky_pairs(0.01)").collect()}
    assert got == {(x.source_id, x.source_id_b) for x in crossmatch.sky_join(stars, stars, 0.01).collect()}
    ours = {(x.c1, x.c2): x.matches for x in crossmatch.catalog_overlap(stars, 30.0).collect() if x.matches}
    assert ours and {(x.c1, x.c2): x.matches for x in spark.sql("SELECT * FROM overlap(30)").collect()} == ours
    best = discovery.base_score(stars, profile("strict")).orderBy(F.desc("base_score"), "source_id").limit(7)
    assert [x.source_id for x in spark.sql("SELECT * FROM ranking(7, 'strict') ORDER BY place").collect()] == [x.source_id for x in best.collect()]
    texts = spark.createDataFrame([("1", "One. " * 900), ("2", ""), ("3", None), ("4", "x" * 2500)], "arxiv_id string, abstract string")
    texts.createOrReplaceTempView("some_texts")
    chunks = spark.sql("SELECT arxiv_id, c.chunk_no, c.chunk FROM some_texts, LATERAL text_chunks(abstract, 1000, 200) AS c")
    assert sorted(tuple(x) for x in chunks.collect()) == sorted(tuple(x) for x in documents.chunk_text(texts).collect())
    assert spark.sql("SELECT unit_of('ra'), unit_of('x'), named_cluster('M45'), percentile(v, 0.25) FROM VALUES (1), (2) AS t(v)").first()[:] == ("deg", None, "pleiades", 1.25)
