"""Sky geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.columns import col


def separation_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance in degrees by the haversine form, exact from arc-seconds to 180 degrees."""
    ra1, dec1, ra2, dec2 = (F.radians(col(c)) for c in (ra1, dec1, ra2, dec2))
    h = F.pow(F.sin((dec2 - dec1) / 2), 2) + F.cos(dec1) * F.cos(dec2) * F.pow(F.sin((ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h))))


def _unit(x: Column) -> Column:
    """Rounding errors beyond -1 and 1 cut off; null stays null, which least and greatest would skip."""
    return F.when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x)


def in_cone(ra, dec, ra0, dec0, radius_deg) -> Column:
    """A declination band, which reaches the scan's filters, and the exact test; null positions are outside."""
    ra, dec, ra0, dec0, r = (col(c) for c in (ra, dec, ra0, dec0, radius_deg))
    band = dec.between(dec0 - r, dec0 + r)
    return F.coalesce(ra.isNotNull() & band & (separation_deg(ra, dec, ra0, dec0) <= r), F.lit(False))


def radius_to_deg(value: float, unit: str = "deg") -> float:
    return value / {"arcmin": 60.0, "arcsec": 3600.0}.get((unit or "deg").strip().lower(), 1.0)


def galactic_to_icrs(lon, lat) -> tuple[Column, Column]:
    """ICRS right ascension and declination from galactic longitude and latitude (published J2000 pole)."""
    pole_ra, pole_dec, node = 192.85948, 27.12825, 122.93192
    b, dl = F.radians(col(lat)), F.radians(F.lit(node) - col(lon))
    sin_d, cos_d = F.sin(F.radians(F.lit(pole_dec))), F.cos(F.radians(F.lit(pole_dec)))
    s = sin_d * F.sin(b) + cos_d * F.cos(b) * F.cos(dl)
    dec = F.degrees(F.asin(_unit(s)))
    ra = F.lit(pole_ra) + F.degrees(F.atan2(F.cos(b) * F.sin(dl), cos_d * F.sin(b) - sin_d * F.cos(b) * F.cos(dl)))
    return F.pmod(ra, F.lit(360.0)), dec


def to_icrs(lon, lat, frame: str = "icrs") -> tuple[Column, Column]:
    """ICRS and FK5 J2000 (tens of milli-arcseconds apart) pass through; so do unknown frames."""
    return galactic_to_icrs(lon, lat) if (frame or "").strip().lower() == "galactic" else (col(lon), col(lat))


def distance_pc(parallax) -> Column:
    p = col(parallax)
    return F.when(p > 0, 1000.0 / p)


def light_years(parsec) -> Column:
    return col(parsec) * 3.26156


def to_cartesian(ra, dec, distance) -> tuple[Column, Column, Column]:
    """Parsec, with y up."""
    a, d, r = F.radians(col(ra)), F.radians(col(dec)), col(distance)
    return r * F.cos(d) * F.cos(a), r * F.sin(d), r * F.cos(d) * F.sin(a)


def from_cartesian(x, y, z) -> tuple[Column, Column, Column]:
    """(ra, dec, distance); nulls for the zero vector."""
    x, y, z = col(x), col(y), col(z)
    r = F.sqrt(x * x + y * y + z * z)
    r = F.when(r > 0, r)
    return F.when(r > 0, F.pmod(F.degrees(F.atan2(z, x)) + 360.0, F.lit(360.0))), F.degrees(F.asin(_unit(y / r))), r


def sexagesimal(ra, dec) -> tuple[Column, Column]:
    """Hours and signed degrees as text, to 0.0001 s and 0.001 arc-seconds."""

    def parts(value: Column, decimals: int) -> tuple[Column, Column, Column]:
        total = F.round(value * 3600, decimals)
        return F.floor(total / 3600).cast("long"), F.floor(F.pmod(total, F.lit(3600.0)) / 60).cast("long"), F.pmod(total, F.lit(60.0))

    h, m, s = parts(F.pmod(col(ra), F.lit(360.0)) / 15, 4)
    d, arcmin, arcsec = parts(F.abs(col(dec)), 3)
    return F.format_string("%02d:%02d:%07.4f", h, m, s), F.format_string("%s%02d.%02d.%06.3f", F.when(col(dec) < 0, "-").otherwise("+"), d, arcmin, arcsec)


def mjd(timestamp) -> Column:
    return F.unix_micros(col(timestamp)) / 86400000000.0 + 40587.0


def from_mjd(value) -> Column:
    return F.timestamp_micros(F.round((col(value) - 40587.0) * 86400000000.0).cast("long"))


def sky_link(ra, dec, radius_deg) -> Column:
    """Deep link of a public sky viewer; the field is at least 0.02 degrees."""
    return F.format_string("https://aladin.u-strasbg.fr/AladinLite/?target=%.6f%%20%.6f&fov=%.4f", col(ra), col(dec), F.greatest(2 * col(radius_deg), F.lit(0.02)))
