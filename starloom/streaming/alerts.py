"""Alerts as streams: late data, once-only delivery, cross-match, continuous upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators.crossmatch import sky_join
from starloom.operators.upserts import upsert_transients
from starloom.streaming import versions


def alert_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Landed files as a stream; time stamps without a zone become instants, as watermarks need."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(path)
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def once_only(alerts: DataFrame, days: int = 30, key: str = "name") -> DataFrame:
    """Each name once within the look-back; older rows are late and dropped by the watermark."""
    return alerts.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark([key])


def matched(alerts: DataFrame, stars: DataFrame, arcsec: float = 3.0) -> DataFrame:
    """Stream-static cross-match: the static side is in cells, so each batch is an equi-join."""
    return sky_join(alerts, stars.select("source_id", "ra", "dec"), arcsec / 3600, key="name").withColumn("separation_arcsec", F.col("sep_deg") * 3600)


def type_counts(alerts: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by type in tumbling windows, or sliding ones with ``slide``."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return alerts.withWatermark("ts", late).groupBy(w, "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n")


def session_counts(alerts: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return alerts.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "type").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "type", "n")


def transient_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's alerts (name, ra, dec, mag, type, ts) are upserted into the versioned stars at ``path``.

    Of alerts that repeat a name in a batch, the latest counts. Replays of a batch change nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = Window.partitionBy("name").orderBy(F.desc("ts"), "ra", "dec", "mag", "type")
        one = batch.where("name IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        keys = one.select(F.concat(F.lit("GSA_"), F.col("name")).alias("source_id"))
        versions.apply_batch(path, one, batch_id, keys, upsert_transients)

    return apply


def paper_sink(path: str, target: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds new papers, ``target`` a batch at most, to the versioned corpus at ``path``; those already there stay as they are and are not written again."""
    from starloom.operators.documents import build_corpus

    def add(corpus: DataFrame, batch: DataFrame) -> DataFrame:
        return build_corpus(batch, corpus, target).select(*corpus.columns)

    def apply(batch: DataFrame, batch_id: int) -> None:
        versions.apply_batch(path, batch, batch_id, batch.select(F.substring_index("url", "/abs/", -1).alias("arxiv_id")), add, adds=True)

    return apply


def matched_sink(read_stars: Callable[[], DataFrame], out: str, arcsec: float = 3.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is matched with the stars as they are then, and written as a folder of its own.

    The static side is read again for every batch, so stars that were added meanwhile are found; a replay writes its folder anew.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        matched(batch, read_stars(), arcsec).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return apply


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed all landed files to a foreachBatch function, batch by batch, and stop; a later run goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
