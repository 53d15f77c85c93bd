"""Landed alert feeds to one schema: name, ts, type, mag, ra, dec, source. A missing position stays null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.columns import finite
from starloom.functions.sky import from_mjd

COLUMNS = ["name", "ts", "type", "mag", "ra", "dec", "source"]


def read_gsa_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with name, jd, ra, dec, mag, class, disc_mag."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True)
    return df.select(F.trim("name").alias("name"), from_mjd(finite("jd") - 2400000.5).alias("ts"), F.coalesce(F.when(F.trim("class") != "", F.trim("class")), F.lit("unknown")).alias("type"), F.coalesce(finite("mag"), finite("disc_mag")).alias("mag"), finite("ra").alias("ra"), finite("dec").alias("dec"), F.lit("GSA").alias("source"))


def read_tns_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with data.reply[]."""
    schema = "data struct<reply: array<struct<objname: string, radeg: string, decdeg: string, object_type: struct<name: string>, discoverydate: string, discoverymag: string>>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data.reply").alias("r"))
    return r.select(F.col("r.objname").alias("name"), F.col("r.discoverydate").try_cast("timestamp").alias("ts"), F.coalesce("r.object_type.name", F.lit("unknown")).alias("type"), finite("r.discoverymag").alias("mag"), finite("r.radeg").alias("ra"), finite("r.decdeg").alias("dec"), F.lit("TNS").alias("source"))


def read_alerce_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with items[]; the first g magnitude, else r; times are MJD."""
    schema = "items array<struct<oid: string, meanra: double, meandec: double, class: string, firstmjd: double, first_magpsf_g: double, first_magpsf_r: double>>"
    i = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("items").alias("i"))
    return i.select(F.col("i.oid").alias("name"), from_mjd("i.firstmjd").alias("ts"), F.coalesce("i.class", F.lit("unknown")).alias("type"), F.coalesce("i.first_magpsf_g", "i.first_magpsf_r").alias("mag"), F.col("i.meanra").alias("ra"), F.col("i.meandec").alias("dec"), F.lit("ALeRCE").alias("source"))


def recent(alerts: DataFrame, days: int, classes: list[str] | None = None, now=None) -> DataFrame:
    """Alerts of the last ``days``, optionally of some classes."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    df = alerts.where(F.col("ts") >= at - F.make_dt_interval(days=F.lit(days)))
    return df.where(F.col("type").isin(classes)) if classes else df
