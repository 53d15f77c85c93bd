"""Catalog files to the canonical star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.columns import finite, normalize_catalog, prefix_source_id

# Canonical columns, and what other catalogs call them.
CANONICAL = ["source_id", "ra", "dec", "parallax", "parallax_error", "pmra", "pmdec", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "ruwe", "catalog_source", "object_class"]
FIELD_MAPS = {
    "GAIA": {
        "sourceid": "source_id",
        "ra_deg": "ra",
        "dec_deg": "dec",
        "class": "object_class",
        "object_type": "object_class",
        "source_type": "object_class",
        "kind": "object_class",
    },
    "WISE": {
        "designation": "source_id",
        "objid": "source_id",
        "id": "source_id",
        "ra_deg": "ra",
        "dec_deg": "dec",
        "w1mag": "phot_g_mean_mag",
        "w1mpro": "phot_g_mean_mag",
        "w2mag": "phot_bp_mean_mag",
        "w3mag": "phot_rp_mean_mag",
    },
    "2MASS": {
        "designation": "source_id",
        "objid": "source_id",
        "id": "source_id",
        "ra_deg": "ra",
        "dec_deg": "dec",
        "jmag": "phot_g_mean_mag",
        "hmag": "phot_bp_mean_mag",
        "kmag": "phot_rp_mean_mag",
    },
    "PAN-STARRS": {
        "objid": "source_id",
        "obj_id": "source_id",
        "id": "source_id",
        "ra_deg": "ra",
        "dec_deg": "dec",
        "class": "object_class",
        "object_type": "object_class",
        "source_type": "object_class",
        "kind": "object_class",
        "gmag": "phot_g_mean_mag",
        "g_mean_psf_mag": "phot_g_mean_mag",
        "rmag": "phot_bp_mean_mag",
        "r_mean_psf_mag": "phot_bp_mean_mag",
        "imag": "phot_rp_mean_mag",
        "i_mean_psf_mag": "phot_rp_mean_mag",
    },
}
KEY_COLUMNS = ["designation", "objid", "obj_id", "id", "source", "name"]


def catalog_name(catalog: str | None) -> str:
    return (catalog or "GAIA").strip().upper().replace(" ", "-") or "GAIA"


def to_canonical(df: DataFrame, catalog: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """Headers trimmed and lower-cased, fields renamed (the user's map over the catalog's), missing columns null.

    The key comes from source_id, else the first key column at hand, else it is generated. A table without
    ra or dec is an error; what is no finite number becomes null.
    """
    name = catalog_name(catalog)
    names = {c.strip().lower(): c for c in df.columns}
    wanted = {k: k for k in CANONICAL} | FIELD_MAPS.get(name, {}) | {k.strip().lower(): v for k, v in (field_map or {}).items()}
    found: dict[str, list[str]] = {}
    for low, original in names.items():
        if low in wanted:
            found.setdefault(wanted[low], []).append(original)
    missing = [c for c in ("ra", "dec") if c not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    pick = lambda c: F.coalesce(*(F.col(f"`{o}`") for o in found[c]))
    if "source_id" in found:
        key = pick("source_id")
    else:
        key = next((F.col(f"`{names[k]}`") for k in KEY_COLUMNS if k in names), F.monotonically_increasing_id())
    numbers = [c for c in CANONICAL if c not in ("source_id", "catalog_source", "object_class")]
    text = lambda c: pick(c).cast("string") if c in found else F.lit(None).cast("string")
    return df.select(
        prefix_source_id(F.lit(name), key).alias("source_id"),
        *((finite(pick(c)) if c in found else F.lit(None).cast("double")).alias(c) for c in numbers),
        normalize_catalog(F.lit(name)).alias("catalog_source"),
        text("object_class").alias("object_class"),
    ).select(*CANONICAL)


def read_catalog_csv(spark: SparkSession, path: str, catalog: str, field_map: dict | None = None) -> DataFrame:
    """Splittable CSV of any survey; all columns are read as text and cast where they are needed."""
    return to_canonical(spark.read.csv(path, header=True), catalog, field_map)


def read_catalog_json(spark: SparkSession, path: str, catalog: str, lines: bool | None = None, field_map: dict | None = None) -> DataFrame:
    """JSON array, or a record a line where the name says so."""
    by_line = path.endswith((".jsonl", ".ndjson")) if lines is None else lines
    return to_canonical(spark.read.json(path, multiLine=not by_line), catalog, field_map)


def read_gaia_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_catalog_csv(spark, path, "GAIA")


def ingest(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def synthetic_stars(spark: SparkSession, regions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` gaussian stars around each region, for tests."""
    rows = regions.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n > 0 else regions.withColumn("i", F.lit(0).cast("long")).limit(0)
    spread = lambda c, k: F.col(c) + F.randn(seed + k) * F.col("radius_deg") / 3
    return rows.select(F.concat(F.lit("SYN_"), F.replace("name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("i")).alias("source_id"), F.pmod(spread("ra", 0), F.lit(360.0)).alias("ra"), spread("dec", 1).alias("dec"), F.abs(F.randn(seed + 2) + 8).alias("parallax"), (F.randn(seed + 3) * 20).alias("pmra"), (F.randn(seed + 4) * 20).alias("pmdec"), (F.randn(seed + 5) * 2 + 12).alias("phot_g_mean_mag"), F.lit("GAIA").alias("catalog_source"))
