"""Streams over landed files: sinks that survive a stop, sessions, late rows, and a static side that changes."""

import pytest
from pyspark.sql import functions as F

from starloom.streaming import alerts as st
from starloom.streaming import versions

ALERT = "name string, ts timestamp, type string, mag double, ra double, dec double"
STAR = "source_id string, ra double, dec double, phot_g_mean_mag double, catalog_source string, object_class string, is_transient int, alert_name string"


def land(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame([(n, t, k, m, ra, 1.0) for n, t, k, m, ra in rows], "name string, t string, type string, mag double, ra double, dec double").withColumn("ts", F.col("t").cast("timestamp")).select("name", "ts", "type", "mag", "ra", "dec").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def star_table(spark, tmp_path):
    stars = spark.createDataFrame([("GSA_a", 1.0, 1.0, 9.0, "GAIA", None, 0, None), ("7", 2.0, 1.0, 8.0, None, "x", 0, None)], STAR)

    def make(name):
        path = str(tmp_path / name)
        versions.create(stars, path, "source_id", buckets=4)
        return path

    return make


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_stream_stopped_between_write_and_commit_gives_the_same_table(spark, star_table, tmp_path, monkeypatch):
    landed = str(tmp_path / "alerts")
    land(spark, landed, [("a", "2024-01-01 00:00:00", "SN", 15.0, 5.0), ("b", "2024-01-01 00:00:00", "SN", 16.0, 6.0), ("b", "2024-01-02 00:00:00", "CV", 14.0, 6.5)], [("c", "2024-01-03 00:00:00", "SN", 17.0, 7.0), (None, "2024-01-03 00:00:00", "SN", 1.0, 7.0)], [("b", "2024-01-04 00:00:00", "AGN", 13.0, 9.0)])
    stream = lambda: st.alert_stream(spark, landed, spark.read.parquet(landed).schema, files_per_trigger=1)
    once, stopped = star_table("once"), star_table("stopped")
    st.run_to_end(stream(), st.transient_sink(once), str(tmp_path / "c1"))
    publish, calls = versions._publish, []

    def dies(*args):
        calls.append(1)
        if len(calls) in (2, 4):  # the data are written, the version isn't
            raise RuntimeError("lost")
        publish(*args)

    monkeypatch.setattr(versions, "_publish", dies)
    for _ in range(4):
        try:
            st.run_to_end(stream(), st.transient_sink(stopped), str(tmp_path / "c2"))
        except Exception:  # noqa: S110
            pass
    monkeypatch.undo()
    assert len(calls) == 5 and versions.versions(spark, stopped) == [0, 1, 2, 3]
    assert rows(versions.read(spark, stopped).drop("object_class")) == rows(versions.read(spark, once).drop("object_class"))
    got = {r.source_id: r for r in versions.read(spark, stopped).collect()}
    assert set(got) == {"GSA_a", "7", "GSA_b", "GSA_c"} and got["GSA_b"].object_class == "CV" and got["GSA_a"].alert_name == "a"


def test_readers_keep_their_version_and_replays_change_nothing(spark, star_table):
    path = star_table("t")
    pinned = versions.read(spark, path)
    before = rows(pinned)
    alerts = spark.createDataFrame([(f"n{i}", None, "SN", 1.0, float(i), 0.0) for i in range(30)], ALERT)
    sink = st.transient_sink(path)
    sink(alerts, 0)
    sink(alerts.withColumn("type", F.lit("other")), 0)  # the batch is in already
    assert versions.versions(spark, path) == [0, 1] and versions.read(spark, path).count() == 32
    assert rows(pinned) == before == rows(versions.read(spark, path, 0))
    held = versions.entry(spark, path)["folders"]
    sink(alerts.limit(1), 1)
    now = versions.entry(spark, path)["folders"]
    assert sum(held[b] != now[b] for b in held) == 1  # one bucket was written again
    with pytest.raises(RuntimeError):
        versions._publish(spark, path, 2, {})
    assert versions.expire(spark, path, keep=1) > 0 and versions.read(spark, path).count() == 32


def test_late_rows_beyond_the_watermark_are_dropped_and_counted(spark, tmp_path):
    landed, out = str(tmp_path / "alerts"), str(tmp_path / "out")
    day = "2024-01-0{} {}:00".format
    land(
        spark, landed,
        [("a", day(1, "10:00"), "SN", 1.0, 1.0), ("b", day(1, "10:20"), "SN", 1.0, 1.0), ("c", day(1, "11:30"), "SN", 1.0, 1.0)],
        [("d", day(2, "09:00"), "SN", 1.0, 1.0), ("e", day(1, "10:40"), "SN", 1.0, 1.0)],  # e is late, but within a day
        [("f", day(5, "00:00"), "CV", 1.0, 1.0)],
        [("k", day(5, "00:10"), "CV", 1.0, 1.0)],  # rows are late by the watermark of the batch before
        [("g", day(1, "10:50"), "SN", 1.0, 1.0), ("h", day(4, "12:00"), "SN", 1.0, 1.0)],  # g is beyond
        [("i", day(9, "00:00"), "CV", 1.0, 1.0)],
    )
    stream = st.alert_stream(spark, landed, spark.read.parquet(landed).schema, files_per_trigger=1)
    run = st.session_counts(stream, "30 minutes", "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
    found = {(r.type, str(r.start)[:16], r.n) for r in spark.read.schema("start timestamp, end timestamp, type string, n long").parquet(out).collect()}
    assert dropped == 1
    assert found == {("SN", "2024-01-01 10:00", 3), ("SN", "2024-01-01 11:30", 1), ("SN", "2024-01-02 09:00", 1), ("CV", "2024-01-05 00:00", 2), ("SN", "2024-01-04 12:00", 1)}


def test_the_static_side_is_read_again_for_each_batch(spark, star_table, tmp_path):
    landed, path, out = str(tmp_path / "alerts"), star_table("stars"), str(tmp_path / "out")
    land(spark, landed, [("x", "2024-01-01 00:00:00", "SN", 1.0, 50.0)], [("y", "2024-01-02 00:00:00", "SN", 1.0, 50.0)])
    match, upsert = st.matched_sink(lambda: versions.read(spark, path), out), st.transient_sink(path)

    def both(batch, batch_id):  # each batch meets the stars that the ones before have added
        match(batch, batch_id)
        upsert(batch, batch_id)

    st.run_to_end(st.alert_stream(spark, landed, spark.read.parquet(landed).schema, files_per_trigger=1), both, str(tmp_path / "c"))
    assert [(r.name, r.source_id_b) for r in spark.read.parquet(f"{out}/batch=*").collect()] == [("y", "GSA_x")]


def test_papers_that_are_there_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "corpus")
    versions.create(spark.createDataFrame([], "arxiv_id string, title string, abstract string, authors array<string>, embed_text string"), path, "arxiv_id", buckets=2)
    raw = lambda *ids: spark.createDataFrame([(f"u/abs/{i}", f"t{i}", "a", ["A"], 0, n, "c") for n, i in enumerate(ids)], "url string, title string, abstract string, authors array<string>, query_no int, rank int, category string")
    sink = st.paper_sink(path, 1 << 30)
    sink(raw(*range(20)), 0)
    first = {f for held in versions.entry(spark, path)["folders"].values() for f in held}
    sink(raw(*range(10, 30)).withColumn("title", F.lit("again")), 1)
    sink(raw(*range(5)), 2)  # nothing new
    now = {f for held in versions.entry(spark, path)["folders"].values() for f in held}
    assert first and first < now  # before, each batch wrote all rows of its buckets anew
    got = {r.arxiv_id: r.title for r in versions.read(spark, path).collect()}
    assert versions.read(spark, path).count() == len(got) == 30 and got["12"] == "t12" and got["25"] == "again"
    assert versions.expire(spark, path, keep=1) == 0 and versions.read(spark, path).count() == 30


def test_batches_are_as_many_as_slices_not_files(spark, tmp_path):
    from starloom.queries.streams import _files_a_batch, _landed

    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS name", "timestamp_seconds(id * 3600) AS ts").repartition(6)
    path = _landed(rows, "alerts")
    assert len(spark.read.parquet(path).inputFiles()) > 4
    seen = []
    stream = st.alert_stream(spark, path, rows.schema, files_per_trigger=_files_a_batch(spark, path, 4))
    st.run_to_end(stream, lambda batch, _: seen.append(batch.count()), str(tmp_path / "c"))
    assert sum(seen) == 400 and len([n for n in seen if n]) <= 4
