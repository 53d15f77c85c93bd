"""Upserts without a table format: each returns the table's next version, written elsewhere by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, key: list[str] | str, order_col: str | None = None) -> DataFrame:
    """Rows of ``batch`` replace rows of ``target`` with their key; the largest ``order_col`` wins within the batch."""
    keys = [key] if isinstance(key, str) else key
    if order_col is not None:
        last = Window.partitionBy(*keys).orderBy(F.desc(order_col), *(F.desc(c) for c in batch.columns if c not in (*keys, order_col)))
        batch = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    else:
        batch = batch.dropDuplicates(keys)
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """New keys only; existing rows stay as they are."""
    return target.unionByName(batch.dropDuplicates([key]).join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_transients(stars: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts (name, ra, dec, mag, type) become stars keyed GSA_<name>; a known one only gets its flag, name and missing class."""
    new = alerts.dropDuplicates(["name"]).select(F.concat(F.lit("GSA_"), F.col("name")).alias("source_id"), F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.col("mag").alias("_mag"), F.col("type").alias("_class"), F.col("name").alias("_name"))
    both = stars.withColumn("_old", F.lit(True)).join(new, "source_id", "full_outer")
    hit, fresh = F.col("_name").isNotNull(), F.col("_old").isNull()
    special = {
        "source_id": F.col("source_id"),
        "ra": F.when(fresh, F.col("_ra")).otherwise(F.col("ra")),
        "dec": F.when(fresh, F.col("_dec")).otherwise(F.col("dec")),
        "phot_g_mean_mag": F.when(fresh, F.col("_mag")).otherwise(F.col("phot_g_mean_mag")),
        "catalog_source": F.when(fresh, "GAIA_ALERTS").otherwise(F.col("catalog_source")),
        "is_transient": F.when(hit, 1).otherwise(F.col("is_transient")),
        "alert_name": F.when(hit, F.col("_name")).otherwise(F.col("alert_name")),
        "object_class": F.coalesce("object_class", F.when(hit, F.col("_class"))),
    }
    return both.select(*(special.get(c, F.col(c)).alias(c) for c in stars.columns))


def upsert_regions(regions: DataFrame, batch: DataFrame, keep_count: bool = True) -> DataFrame:
    """Regions by name; ``keep_count`` leaves the stored star_count alone."""
    if keep_count:
        old = regions.select("name", F.col("star_count").alias("_count"))
        batch = batch.drop("star_count").join(old, "name", "left").withColumn("star_count", F.coalesce("_count", F.lit(0).cast("long"))).drop("_count")
    return upsert(regions, batch.select(*regions.columns), "name")


def region_extract(raw: DataFrame, ra: float, dec: float, radius: float, max_stars: int, offset: int = 0) -> DataFrame:
    """A page of an archive dump's circle: parallax above 0 and G below 18, by source_id."""
    from starloom.functions.sky import in_cone

    return raw.where(in_cone("ra", "dec", ra, dec, radius) & (F.col("parallax") > 0) & (F.col("phot_g_mean_mag") < 18)).orderBy("source_id").offset(offset).limit(max_stars)


def region_extract_brightest(raw: DataFrame, regions: DataFrame, n: int) -> DataFrame:
    """The ``n`` brightest stars of each region."""
    from starloom.operators.crossmatch import region_members

    order = Window.partitionBy("region").orderBy("phot_g_mean_mag", "source_id")
    members = region_members(raw.where("parallax IS NOT NULL AND phot_g_mean_mag IS NOT NULL"), regions)
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ingest_region(raw: DataFrame, stars: DataFrame, regions: DataFrame, region: tuple, max_stars: int = 1000, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stars, regions) after the extract of one region (name, ra, dec, radius_deg): new rows added, or old ones refreshed."""
    name, ra, dec, radius = region
    got = region_extract(raw, ra, dec, radius, max_stars).select(*stars.columns)
    after = upsert(stars, got, "source_id") if refresh else insert_ignore(stars, got, "source_id")
    added = got.join(stars.select("source_id"), "source_id", "left_anti").agg(F.count("*").alias("star_count"))
    row = stars.sparkSession.createDataFrame([region], "name string, ra double, dec double, radius_deg double").join(added)
    return after, upsert_regions(regions, row, keep_count=False)


def upsert_nodes(nodes: DataFrame, kind: str, batch: DataFrame, key: str) -> DataFrame:
    """Graph nodes (kind, id, props): one per kind and key, the batch's properties as JSON."""
    new = batch.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*[c for c in batch.columns if c != key])).alias("props"))
    return upsert(nodes, new, ["kind", "id"])


def append_messages(store: DataFrame, batch: DataFrame) -> DataFrame:
    return store.unionByName(batch, allowMissingColumns=True)


def delete_session(sessions: DataFrame, messages: DataFrame, conv_id) -> tuple[DataFrame, DataFrame]:
    """Both tables without a session and its messages."""
    keep = lambda t: t.where(~F.coalesce(F.col("conv_id") == conv_id, F.lit(False)))
    return keep(sessions), keep(messages)
