"""Small helpers on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column name, a Column or a number."""
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def bound(value, use) -> Column:
    """``use(value)`` with the value computed once a row: inside a lambda function Spark computes what a column stands for at every mention, and for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite(value) -> Column:
    """A double, or null for what is no number, NaN or infinite."""
    x = col(value).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalize_object_class(value) -> Column:
    text = F.trim(F.regexp_replace(F.translate(col(value), "_/", "  "), r"\s+", " "))
    return F.upper(F.when(text != "", text))


def normalize_catalog(value, when_missing: str = "GAIA") -> Column:
    """Trimmed upper-case label with hyphens; blank and null become ``when_missing``."""
    text = F.upper(F.trim(col(value)))
    return F.translate(F.when(text != "", text).otherwise(F.lit(when_missing)), " ", "-") if when_missing == "GAIA" else F.coalesce(F.when(text != "", text), F.lit(when_missing))


def prefix_source_id(catalog, raw) -> Column:
    """``CATALOG:raw``; GAIA keys stay bare, prefixed keys stay as they are, blank keys become unknown."""
    name, key = normalize_catalog(catalog), F.coalesce(F.trim(col(raw).cast("string")), F.lit(""))
    key = F.when(key == "", "unknown").otherwise(key)
    return F.when((name == "GAIA") | F.upper(key).startswith(F.concat(name, F.lit(":"))), key).otherwise(F.concat(name, F.lit(":"), key))


def uuid5_dns(name) -> Column:
    """UUID version 5 in the DNS name space."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(col(name), "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.lower(F.hex(variant)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
