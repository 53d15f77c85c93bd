"""Neighbours counted inside a tile of the sky: strips of declination, sorted along right ascension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Degrees around the radius in which a pair is not decided here, but by the exact separation in Spark.
TIE = 1e-9
#: Pairs on the rim of a circle that are looked into at a time.
RIM = 1 << 20


def _width(share: np.ndarray) -> np.ndarray:
    """Right ascension (degrees) to either side of a share of the parallel's haversine: -1 for none, 180 for all of it."""
    return np.where(share < 0, -1.0, np.degrees(2 * np.arcsin(np.sqrt(np.clip(share, 0, 1)))))


def _strips(east: np.ndarray, dec: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in strips of equal numbers, each sorted by right ascension; about the root of the rows, so that many stars make thin strips."""
    order = np.argsort(dec, kind="stable")
    for part in np.array_split(order, max(1, int(np.sqrt(len(order))))):
        yield part[np.argsort(east[part], kind="stable")]


def _ranges(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, member) of every member of the ranges, ``RIM`` at a time."""
    size = np.maximum(last - first, 0)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + RIM, "right")))
        own = size[at:to]
        place = np.repeat(np.arange(at, to), own)
        yield place, np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own) + first[place]
        at = to


def within(ra1: np.ndarray, dec1: np.ndarray, ra2: np.ndarray, dec2: np.ndarray, radius: float) -> np.ndarray:
    """Whether each pair is one that ``counts`` counts."""
    ra1, dec1, ra2, dec2 = map(np.radians, (ra1, dec1, ra2, dec2))
    away = np.sin((dec2 - dec1) / 2) ** 2 + np.cos(dec1) * np.cos(dec2) * np.sin((ra2 - ra1) / 2) ** 2
    return away < np.sin(np.radians(radius - TIE) / 2) ** 2


def counts(pe: np.ndarray, pd: np.ndarray, oe: np.ndarray, od: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, point, other): how many others lie within the radius of each point, and the pairs within ``TIE`` of it, which n leaves out.

    Right ascensions are offsets of -180 to 180 from one meridian. Of a strip, what lies east and west of a point nearer than the circle does at the
    strip's lower and upper end is within, what lies farther than it does anywhere in the strip is not; both are told by
    search in the sorted strip. Only what lies between, on the rim of the circle, is looked into one by one.
    """
    n, ties = np.zeros(len(pe), np.int64), []
    if not len(pe) or not len(oe):
        return n, np.empty(0, np.int64), np.empty(0, np.int64)
    by_ra = np.argsort(pe, kind="stable")
    se, sd = pe[by_ra], pd[by_ra]
    p, other_p, other_e = np.radians(sd), np.radians(od), np.radians(oe)
    cosine, other_cosine = np.cos(p), np.cos(other_p)
    small, large = (np.sin(np.radians(radius + away) / 2) ** 2 for away in (-TIE, TIE))
    # The circle is widest at this declination; none where it holds a pole.
    with np.errstate(invalid="ignore", divide="ignore"):
        widest_at = np.degrees(np.arcsin(np.sin(p) / np.cos(np.radians(radius + TIE))))
        widest = np.sin(np.arcsin(np.sin(np.radians(radius + TIE)) / cosine) / 2) ** 2
    for strip in _strips(oe, od):
        low, high = od[strip].min(), od[strip].max()
        mine = np.flatnonzero((sd >= low - radius - 2 * TIE) & (sd <= high + radius + 2 * TIE))
        if not len(mine):
            continue
        e, d = se[mine], sd[mine]
        inner, outer = None, None
        for at in (low, high):
            at = np.radians(at)
            far, across = np.sin((at - p[mine]) / 2) ** 2, np.maximum(cosine[mine] * np.cos(at), 1e-18)
            near, most = (small - far) / across, (large - far) / across
            inner = near if inner is None else np.minimum(inner, near)
            outer = most if outer is None else np.maximum(outer, most)
        crest = (widest_at[mine] >= low - TIE) & (widest_at[mine] <= high + TIE)
        inner, outer = _width(inner), _width(np.where(crest, np.fmax(outer, widest[mine]), outer))
        reach = np.where(outer < 0, -1.0, np.minimum(outer + TIE, 180.0))
        sure = np.where(inner >= 180.0, 180.0, inner - TIE)
        members = strip
        if np.abs(e).max() + reach.max() > 179.0:
            o = oe[strip]
            members = np.concatenate([strip[o > 0], strip, strip[o <= 0]])
            ra = np.concatenate([o[o > 0] - 360.0, o, o[o <= 0] + 360.0])
        else:
            ra = oe[strip]
        first = np.searchsorted(ra, e - reach, "left")
        last = np.where(reach < 0, first, np.minimum(np.searchsorted(ra, e + reach, "right"), first + len(strip)))
        begin = np.where(sure < 0, first, np.clip(np.searchsorted(ra, e - sure, "left"), first, last))
        end = np.where(sure < 0, first, np.clip(np.searchsorted(ra, e + sure, "right"), begin, last))
        begin, end = np.where(sure >= 180.0, first, begin), np.where(sure >= 180.0, last, end)
        found, own_p, own_e, own_cosine = end - begin, p[mine], np.radians(e), cosine[mine]
        for lo, hi in ((first, begin), (end, last)):
            for place, member in _ranges(lo, hi):
                other = members[member]
                away = np.sin((other_p[other] - own_p[place]) / 2) ** 2 + own_cosine[place] * other_cosine[other] * np.sin((other_e[other] - own_e[place]) / 2) ** 2
                found += np.bincount(place[away < small], minlength=len(mine))
                close = (away >= small) & (away <= large)
                if close.any():
                    ties.append((by_ra[mine[place[close]]], other[close]))
        n[by_ra[mine]] += found
    point, other = (np.concatenate(x) for x in zip(*ties, strict=True)) if ties else (np.empty(0, np.int64),) * 2
    return n, point, other
