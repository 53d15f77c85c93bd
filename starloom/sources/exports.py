"""Sinks: each row's text is made by Column expressions and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.columns import col, finite
from starloom.functions.sky import sexagesimal
from starloom.functions.stellar import bp_rp, physical_parameters

# Exported columns in order.
FIELDS = ["source_id", "ra", "dec", "parallax", "parallax_error", "pmra", "pmra_error", "pmdec", "pmdec_error", "radial_velocity", "radial_velocity_error", "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "bp_rp", "ruwe", "discovery_score", "discovery_reasons"]
UNITS = {"ra": "deg", "dec": "deg", "parallax": "mas", "parallax_error": "mas", "pmra": "mas/yr", "pmra_error": "mas/yr", "pmdec": "mas/yr", "pmdec_error": "mas/yr", "radial_velocity": "km/s", "radial_velocity_error": "km/s", "phot_g_mean_mag": "mag", "phot_bp_mean_mag": "mag", "phot_rp_mean_mag": "mag", "bp_rp": "mag"}


def export_table(df: DataFrame) -> DataFrame:
    """The exported columns; those that are missing are null, reasons are joined."""
    have = set(df.columns)

    def field(c: str) -> Column:
        if c == "bp_rp" and {"phot_bp_mean_mag", "phot_rp_mean_mag"} <= have:
            return bp_rp()
        if c == "discovery_reasons":
            return F.concat_ws("; ", F.col(c)) if c in have else F.lit("")
        return F.col(c) if c in have else F.lit(None).cast("string" if c == "source_id" else "double")

    return df.select(*(field(c).alias(c, metadata={"unit": UNITS[c]} if c in UNITS else {}) for c in FIELDS))


def export_csv(df: DataFrame, path: str) -> None:
    export_table(df).write.csv(path, header=True)


def export_json(df: DataFrame, path: str, query: str = "") -> None:
    """Rows under ``path/rows``, column units and provenance under ``path/metadata``."""
    t = export_table(df)
    t.write.json(f"{path}/rows")
    units = df.sparkSession.createDataFrame([(c, UNITS.get(c)) for c in FIELDS], "column string, unit string")
    units.withColumn("query", F.lit(query)).withColumn("created", F.current_timestamp()).coalesce(1).write.json(f"{path}/metadata")


def export_topcat(df: DataFrame, path: str) -> None:
    """CSV rows, and the comment lines that describe the columns."""
    export_csv(df, f"{path}/rows")
    lines = [f"# {c} [{UNITS[c]}]" if c in UNITS else f"# {c}" for c in FIELDS]
    df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/header")


def _seven(value) -> Column:
    """Seven significant digits, trailing zeros dropped; nothing for what is no finite number."""
    x = finite(value)
    digits = F.when(x == 0, 0).otherwise(6 - F.floor(F.log10(F.abs(x)))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    plain = (F.round(x * scale) / scale).cast("decimal(30,12)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    inside = F.abs(x).between(1e-4, 9999999.0) | (x == 0)
    return F.coalesce(F.when(inside, short).otherwise(F.format_string("%.6e", x)), F.lit(""))


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def votable_rows(df: DataFrame, aladin: bool = False) -> DataFrame:
    """(source_id, row): a TR element per star; the Aladin form repeats the position at its end."""
    t = export_table(df)
    cells = [F.coalesce(_escaped(F.col(c)), F.lit("")) if c in ("source_id", "discovery_reasons") else _seven(c) for c in FIELDS]
    cells += [_seven("ra"), _seven("dec")] if aladin else []
    return t.select("source_id", F.concat(F.lit("<TR>"), *(F.concat(F.lit("<TD>"), c, F.lit("</TD>")) for c in cells), F.lit("</TR>")).alias("row"))


def ds9_region_lines(df: DataFrame, radius_arcsec: float = 10.0, score: str = "discovery_score") -> DataFrame:
    """A circle per star: red from a score of 15, yellow from 10, else green."""
    colour = F.when(F.col(score) >= 15, "red").when(F.col(score) >= 10, "yellow").otherwise("green")
    return df.where("ra IS NOT NULL AND dec IS NOT NULL").select(F.format_string(f'circle(%.6f,%.6f,{radius_arcsec:g}") # color=%s text={{%s}}', F.col("ra"), F.col("dec"), colour, F.col("source_id")).alias("value"))


def crtf_region_lines(df: DataFrame, radius_arcsec: float = 5.0) -> DataFrame:
    ra, dec = sexagesimal("ra", "dec")
    return df.where("ra IS NOT NULL AND dec IS NOT NULL").select(F.format_string(f"circle [[%s, %s], {radius_arcsec:g}arcsec] coord=ICRS, label='%s'", ra, dec, F.col("source_id")).alias("value"))


def inlist_text(df: DataFrame) -> DataFrame:
    """(source_id, value): a stellar-model parameter file per star."""
    p = df.withColumn("_p", physical_parameters(F.col("teff_estimated_k") if "teff_estimated_k" in df.columns else None))
    lines = [F.lit("&star_job"), F.lit("/"), F.lit("&controls"), F.format_string("  initial_mass = %.2f", F.col("_p.initial_mass")), F.format_string("  initial_z = %.4f", F.col("_p.initial_z")), F.lit("/")]
    return p.select("source_id", F.concat_ws("\n", F.concat(F.lit("! "), F.col("source_id")), *lines).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select(col("value")).write.text(path)


def audit_record(spark, action: str, params: dict, raw_query: str = "", catalog: str = "", tags: list[str] = ()) -> DataFrame:
    """One provenance row."""
    row = [(action, {k: str(v) for k, v in params.items()}, raw_query, catalog, list(tags))]
    return spark.createDataFrame(row, "action string, params map<string, string>, raw_query string, catalog string, tags array<string>").withColumn("at", F.current_timestamp())


def append_audit(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)
