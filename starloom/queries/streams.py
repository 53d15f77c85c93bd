"""Queries that run alerts as streams, and the same summaries as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.tables import table
from starloom.plans.durable import durable, new_path
from starloom.plans.fixtures import alerts, papers, stars, with_views
from starloom.queries.sky import sep
from starloom.streaming import alerts as st
from starloom.streaming import versions

_DAILY = "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2"


def _shown(counts):
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "type", "n")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))


def alert_daily_counts(spark, sf_dir):
    return _shown(st.type_counts(_events(spark, sf_dir)))


def alert_daily_counts_stream(spark, sf_dir):
    """The same counts by a stream over the events file, run to its end in complete mode."""
    path = f"{sf_dir}/events.parquet*"  # a glob: a stream takes no single file
    events = st.alert_stream(spark, path, spark.read.parquet(path).schema).withColumnRenamed("event_type", "type")
    out = new_path(spark, "daily")
    write = lambda counts, batch_id: counts.write.mode("overwrite").parquet(out)  # noqa: E731, ARG005: each batch holds all counts
    st.type_counts(events).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.schema("start timestamp, end timestamp, type string, n long").parquet(out))


def alert_once_only_stream(spark, sf_dir):
    """Alerts delivered once by name, written by a stream and read back."""
    path = f"{sf_dir}/events.parquet*"  # a glob: a stream takes no single file
    events = st.alert_stream(spark, path, spark.read.parquet(path).schema).select(F.col("user_id").cast("string").alias("name"), "ts", F.col("event_type").alias("type"))
    out = new_path(spark, "once")
    run = st.once_only(events, 60).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("name string, ts timestamp, type string").parquet(out).select("name")


def _landed(df, name: str, slices: int = 4) -> str:
    """A folder of files that landed one slice after the other, in the order of ``ts``."""
    path, df = new_path(df.sparkSession, name), durable(df, name)  # read once a slice
    first, last = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = -(-(last - first + 1) // slices)
    for i in range(slices):
        df.where(F.floor((F.unix_micros("ts") - first) / step) == i).write.mode("append").parquet(path)
    return path


def _files_a_batch(spark, path: str, batches: int) -> int:
    """Files a trigger takes, so that a folder is through in so many batches however many files its writers left."""
    return -(-len(spark.read.parquet(path).inputFiles()) // batches)


_SESSION = """WITH e AS (SELECT event_type AS type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events),
s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > INTERVAL 30 MINUTE) OVER (PARTITION BY type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY type, k"""


def alert_sessions_stream(spark, sf_dir):
    """Sessions of each type, closed after half an hour without an alert, from files that land one after the other.

    A last alert far in the future lets the watermark pass all others, so every session is closed and written.
    """
    events = _events(spark, sf_dir)
    path = _landed(events, "events")
    spark.createDataFrame([("last", "end")], "name string, type string").select("name", F.lit("2200-01-01").cast("timestamp").alias("ts"), "type").write.mode("append").parquet(path)
    spark.createDataFrame([("last", "end")], "name string, type string").select("name", F.lit("2200-01-02").cast("timestamp").alias("ts"), "type").write.mode("append").parquet(path)
    stream = st.alert_stream(spark, path, events.schema, files_per_trigger=1)
    out = new_path(spark, "sessions")
    st.session_counts(stream, "30 minutes", "10 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("start timestamp, end timestamp, type string, n long").parquet(out).where("type <> 'end'")
    return found.select("type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def alert_sliding_counts(spark, sf_dir):
    return _shown(st.type_counts(_events(spark, sf_dir), "1 day", "12 hours"))


def _alert_rows(spark, sf_dir):
    return alerts(spark, sf_dir).select("name", "ts", "type", F.col("mag").cast("double").alias("mag"), "ra", "dec")


def transients_stream(spark, sf_dir):
    """All alerts upserted into the stars by a stream over several landed slices, one a batch; half of the alerts come twice."""
    rows = durable(_alert_rows(spark, sf_dir), "rows")
    path = _landed(rows, "alerts")
    rows.where("substring(name, -1) IN ('0', '2', '4', '6', '8')").write.mode("append").parquet(path)
    table_path = new_path(spark, "stars")
    versions.create(stars(spark, sf_dir), table_path, "source_id")
    st.run_to_end(st.alert_stream(spark, path, rows.schema, files_per_trigger=_files_a_batch(spark, path, 5)), st.transient_sink(table_path), new_path(spark, "stream"))
    return versions.read(spark, table_path).select("source_id", "catalog_source", "is_transient", "alert_name")


def papers_stream(spark, sf_dir):
    """Papers collected by a stream over several landed slices; what comes again, under a later query, is left out."""
    p = papers(spark, sf_dir).select(F.concat(F.lit("http://a.example/abs/"), "arxiv_id").alias("url"), "title", "abstract", F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")).alias("authors"), F.lit(0).alias("query_no"), F.lit(0).alias("rank"), F.col("categories").alias("category"))
    path = new_path(spark, "papers")
    for i in range(3):
        p.where(F.pmod(F.xxhash64("url"), F.lit(3)) == i).write.mode("append").parquet(path)
    p.withColumn("query_no", F.lit(1)).withColumn("title", F.lit("again")).write.mode("append").parquet(path)
    corpus = new_path(spark, "corpus")
    versions.create(spark.createDataFrame([], "arxiv_id string, title string, abstract string, authors array<string>, embed_text string"), corpus, "arxiv_id")
    stream = st.alert_stream(spark, path, p.schema, files_per_trigger=_files_a_batch(spark, path, 4))
    st.run_to_end(stream, st.paper_sink(corpus, 1 << 30), new_path(spark, "stream"))
    return versions.read(spark, corpus).select("arxiv_id", "title", F.size("authors").alias("n_authors"))


def alert_matches_stream(spark, sf_dir):
    """Alerts matched with the stars as a stream: every star within three arc-seconds of an alert."""
    rows = _alert_rows(spark, sf_dir)
    out = new_path(spark, "matches")
    path = _landed(rows, "alerts")
    st.run_to_end(st.alert_stream(spark, path, rows.schema, files_per_trigger=_files_a_batch(spark, path, 4)), st.matched_sink(lambda: stars(spark, sf_dir), out), new_path(spark, "stream"))
    return spark.read.parquet(f"{out}/batch=*").select("name", F.col("source_id_b").alias("source_id"), F.round("separation_arcsec", 4).alias("separation_arcsec"))


_ALERTS = with_views("stars", "alerts")
_TRANSIENTS = f"{_ALERTS} SELECT source_id, catalog_source, is_transient, alert_name FROM stars UNION ALL SELECT DISTINCT 'GSA_' || name, 'GAIA_ALERTS', 1, name FROM alerts"
_SLIDING = "SELECT CAST(date_trunc('day', ts) + INTERVAL (h) HOUR AS VARCHAR) AS start, event_type AS type, count(*) AS n FROM events, (VALUES (-12), (0), (12)) AS v(h) WHERE ts >= date_trunc('day', ts) + INTERVAL (h) HOUR AND ts < date_trunc('day', ts) + INTERVAL (h) HOUR + INTERVAL 1 DAY GROUP BY 1, 2"
_MATCHES = f"""{_ALERTS}, z AS (SELECT source_id, ra, dec, unnest([CAST(floor((dec + 90) / 0.01) AS BIGINT) - 1, CAST(floor((dec + 90) / 0.01) AS BIGINT), CAST(floor((dec + 90) / 0.01) AS BIGINT) + 1]) AS zz FROM stars WHERE ra IS NOT NULL),
m AS (SELECT a.name, z.source_id, {sep('a.ra', 'a.dec', 'z.ra', 'z.dec')} AS d FROM alerts a JOIN z ON zz = CAST(floor((a.dec + 90) / 0.01) AS BIGINT)) SELECT name, source_id, round(d * 3600, 4) AS separation_arcsec FROM m WHERE d <= 3.0 / 3600"""

QUERIES = {
    "alert_daily_counts": alert_daily_counts,
    "alert_daily_counts_stream": alert_daily_counts_stream,
    "alert_once_only_stream": alert_once_only_stream,
    "alert_sessions_stream": alert_sessions_stream,
    "alert_sliding_counts": alert_sliding_counts,
    "transients_stream": transients_stream,
    "papers_stream": papers_stream,
    "alert_matches_stream": alert_matches_stream,
}
ORACLES = {
    "alert_daily_counts": _DAILY,
    "alert_daily_counts_stream": _DAILY,
    "alert_once_only_stream": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS name FROM events",
    "alert_sessions_stream": _SESSION,
    "alert_sliding_counts": _SLIDING,
    "transients_stream": _TRANSIENTS,
    "papers_stream": f"{with_views('papers')} SELECT DISTINCT arxiv_id, title, 3 AS n_authors FROM papers",
    "alert_matches_stream": _MATCHES,
}
