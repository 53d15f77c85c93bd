"""Positional joins: all pairs within a radius as an equi-join on declination zones and right-ascension cells."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.columns import normalize_catalog
from starloom.functions.sky import in_cone, separation_deg
from starloom.operators import tiles
from starloom.plans.durable import durable

#: Zones are at least this high (degrees): 0.36 arc-seconds. Keys are hashed, so their number costs nothing.
LEAST_ZONE = 1e-4
#: Height of a join's zones in radii: a row of the left side is copied to four cells on average, not to nine.
JOIN_ZONE = 2
#: The same where a radius holds few rows, as a match of one object does: a row is copied to two cells and a quarter, and meets twice the rows.
SPARSE_ZONE = 4
#: Rows of a cell from which it is split, and halvings of its sides at most.
HOT_ROWS, MOST_SPLIT = 2_000, 3
#: Most cells that are split; others are left to adaptive skew handling.
HOT_CELLS = 20_000
#: Most rows of a region or name table that is broadcast; larger ones go through cells.
BROADCAST_ROWS = 10_000


def _reach(zone: Column, height: float, radius: float) -> tuple[Column, Column]:
    """(degrees of right ascension that a radius covers at most around a zone, whether it may cover a pole)."""
    far = F.greatest(F.abs((zone - 1) * height - 90), F.abs((zone + 2) * height - 90))
    lo, hi = F.radians(far - radius), F.radians(far + radius)
    return F.degrees(F.atan(F.sin(F.radians(F.lit(radius))) / F.sqrt(F.abs(F.cos(lo) * F.cos(hi))))), far + radius >= 90


def _cells_in_zone(zone: Column, height: float, radius: float) -> Column:
    """Right-ascension cells of a zone, wide enough that neighbours within the radius are at most one cell apart."""
    width, pole = _reach(zone, height, radius)
    return F.when(pole, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(360.0 / (width * (height / radius if radius else 1.0))).cast("long")))


def _cell(ra, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("long"))


def _placed(df: DataFrame, height: float, spread: bool, radius: float) -> DataFrame:
    """Rows with their (zone, cell) and the zone's number of cells, ``_n``; with ``spread`` one for each cell within the radius, and ``_wide``.

    ``_wide`` is the right ascension (degrees) that bounds the radius in that zone, 360 where it may cover a pole.
    """
    df = df.where(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    zone = lambda away: F.floor((F.col("dec") + 90 + away) / height).cast("long")
    slack = 1e-9
    if not spread:
        df = df.withColumn("_zone", zone(0.0)).withColumn("_n", _cells_in_zone(F.col("_zone"), height, radius))
        return df.withColumn("_cell", _cell("ra", F.col("_n")))
    df = df.withColumn("_zone", F.explode(F.sequence(zone(-radius - slack), zone(radius + slack))))
    width, pole = _reach(F.col("_zone"), height, radius)
    df = df.withColumn("_n", _cells_in_zone(F.col("_zone"), height, radius)).withColumn("_wide", F.when(pole, F.lit(360.0)).otherwise(width + slack))
    # A radius that reaches around the sky is in all cells; others are in the cells from its western to its eastern end.
    cell = lambda away: F.floor((F.pmod("ra", F.lit(360.0)) + away) / 360.0 * F.col("_n")).cast("long")
    first = cell(-F.col("_wide"))
    around = F.transform(F.sequence(first, F.least(cell(F.col("_wide")), first + F.col("_n") - 1)), lambda c: F.pmod(c, F.col("_n")))
    return df.withColumn("_cell", F.explode(around))


def _within_cell(height: float) -> tuple[Column, Column]:
    """(declination above the cell's lower edge, right ascension east of its western edge, -180 to 180), as shares of its sides."""
    up = (F.col("dec") + 90) / height - F.col("_zone")
    east = F.pmod(F.col("ra") - F.col("_cell") * 360.0 / F.col("_n") + 180.0, F.lit(360.0)) - 180.0
    return up, east * F.col("_n") / 360.0


def _split(left: DataFrame, right: DataFrame, height: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_sub``, the part of a dense cell: right rows are in one, left rows in all within the radius.

    Cells of at least ``HOT_ROWS`` right rows are halved along both sides until a part has fewer if they are spread evenly, but
    ``MOST_SPLIT`` times at most beyond the radius' size. So the left rows of one dense field are dealt over many keys, and meet fewer rows outside the radius.
    """
    plain = left.withColumn("_sub", F.lit(0)), right.withColumn("_sub", F.lit(0))
    if right.isStreaming or MOST_SPLIT < 1:
        return plain
    dense = right.where("_n >= 4").groupBy("_zone", "_cell").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= HOT_ROWS)
    most = MOST_SPLIT + int(math.log2(height / max(radius, LEAST_ZONE)))
    rows = [(r._zone, r._cell, 1 << min(most, 1 + int(math.log(r._rows / HOT_ROWS, 4)))) for r in dense.limit(HOT_CELLS).collect()]
    if not rows:
        return plain
    sides = F.broadcast(right.sparkSession.createDataFrame(rows, "_zone long, _cell long, _side int"))
    up, east = _within_cell(height)
    part = lambda share: F.greatest(F.lit(0), F.least(F.col("_side") - 1, F.floor(share * F.col("_side")).cast("int")))
    right = right.join(sides, ["_zone", "_cell"], "left").withColumn("_sub", F.coalesce(part(up) * F.col("_side") + part(east), F.lit(0))).drop("_side")
    slack = 1e-6
    tall, wide = radius / height + slack, _reach(F.col("_zone"), height, radius)[0] * F.col("_n") / 360.0 + slack
    rows_of, columns_of = F.sequence(part(up - tall), part(up + tall)), F.sequence(part(east - wide), part(east + wide))
    near = (up + tall >= 0) & (up - tall <= 1) & (east + wide >= 0) & (east - wide <= 1)
    grid = F.flatten(F.transform(rows_of, lambda r: F.transform(columns_of, lambda c: r * F.col("_side") + c)))
    parts = F.when(F.col("_side").isNull(), F.array(F.lit(0))).when(near, grid)
    left = left.join(sides, ["_zone", "_cell"], "left").withColumn("_sub", F.explode(parts)).drop("_side")
    return left, right


def sky_join(a: DataFrame, b: DataFrame, radius_deg: float, how: str = "inner", sep: str = "sep_deg", key: str = "source_id", zone: int = JOIN_ZONE) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` within ``radius_deg``; b's columns get the suffix ``_b``.

    ``how`` is inner, left, semi or anti; the last three go by ``key`` of a. The left side is copied to the cells
    within the radius, the right to one; the exact separation decides. Null positions match nothing. Dense cells of a right side
    that is no stream are split below the radius (``_split``); what is left of skew goes to adaptive execution. Both sides
    are shuffled and merged: sizes of files say nothing of the copies, so a side is never sent to the driver to be broadcast.
    ``zone`` is the height of the zones in radii: higher ones make fewer copies and more candidates.
    """
    height = max(zone * radius_deg, LEAST_ZONE)
    left = _placed(a, height, True, radius_deg)
    right = _placed(b, height, False, radius_deg)
    left, right = _split(left, right, height, radius_deg)
    right = right.select("_zone", "_cell", "_sub", *(F.col(c).alias(f"{c}_b") for c in b.columns))
    exact = separation_deg("ra", "dec", "ra_b", "dec_b")
    # A box around the row is cheap and drops most candidates before the trigonometry.
    east = F.abs(F.pmod(F.col("ra_b") - F.col("ra") + 180.0, F.lit(360.0)) - 180.0)
    box = (F.abs(F.col("dec") - F.col("dec_b")) <= radius_deg + 1e-9) & (east <= F.col("_wide"))
    pairs = left.drop("_n").join(right.hint("merge"), ["_zone", "_cell", "_sub"]).where(box).withColumn(sep, exact).where(F.col(sep) <= radius_deg).drop("_zone", "_cell", "_sub", "_wide")
    if how == "inner":
        return pairs
    if how in ("semi", "anti"):
        return a.join(pairs.select(key).distinct(), key, f"left_{how}")
    found = pairs.select(key, *(c for c in pairs.columns if c not in a.columns))
    return a.join(found, key, "left")


#: Sides of a radius-sized cell in the two finer levels of the pyramid, and pairs of points below which two cells are not looked into further.
FINE, FINEST, FEW_PAIRS = 16, 64, 64
#: Rows around a point, on average, from which counts come from tiles and the pyramid; below, joining the points is less work.
CROWDED = 400
#: Rows of a tile that its size aims at, its least and greatest height (radii, degrees), rows from which a tile is left to other ways,
#: and the least and widest radius (degrees) that is counted in tiles.
TILE_ROWS, LEAST_TILE, MOST_TILE, FULL_TILE, LEAST_RADIUS, WIDE = 20_000, 4, 10.0, 400_000, 1e-6, 20.0


def _boxes(placed: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The cells of a level: members, tight box, its centre, and the greatest separation of a member from it.

    Along a meridian, then along a parallel, is a way to any member; its length bounds the separation.
    """
    box = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ra").alias("ra0"), F.max("ra").alias("ra1"), F.min("dec").alias("dec0"), F.max("dec").alias("dec1"))
    least = F.when((F.col("dec0") <= 0) & (F.col("dec1") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("dec0"), F.abs("dec1")))
    far = (F.col("dec1") - F.col("dec0")) / 2 + (F.col("ra1") - F.col("ra0")) / 2 * F.cos(F.radians(least))
    out = box.select(*keys, "n", "ra0", "ra1", ((F.col("ra0") + F.col("ra1")) / 2).alias("ra"), ((F.col("dec0") + F.col("dec1")) / 2).alias("dec"), far.alias("far"))
    return out.select(*(F.col(c).alias(f"{tag}_{c}") for c in out.columns))


def counts_within(points: DataFrame, others: DataFrame, radius_deg: float) -> DataFrame:
    """(row, n): how many of ``others`` (ra, dec) lie within the radius of each of the points (row, ra, dec).

    A pyramid of counts. Both sides are summed up in cells of a sixteenth and a sixty-fourth of the radius. Two
    cells whose boxes lie wholly within the radius add their counts, those wholly outside nothing; only pairs of cells that the
    radius cuts are looked into, cell by cell, and at last point by point. So a dense field makes no row for each pair
    of its points. Points without a position, or with none around, have no row.
    """
    height = max(radius_deg, LEAST_ZONE)

    def placed(df: DataFrame) -> DataFrame:
        df = _placed(df.withColumn("ra", F.pmod("ra", F.lit(360.0))), height, False, radius_deg)
        up, east = (F.greatest(F.lit(0), F.least(F.lit(FINEST - 1), F.floor(share * FINEST).cast("long"))) for share in _within_cell(height))
        coarse = (F.col("_zone") * (1 << 22) + F.col("_cell")) * FINEST  # zones and cells are fewer than 2**22
        df = df.withColumn("cell2", (coarse + up) * FINEST + east)
        step = FINEST // FINE
        return df.withColumn("cell1", (coarse + up - up % step) * FINEST + east - east % step).drop("_n")

    a, b = durable(placed(points.select("row", "ra", "dec")), "points"), durable(placed(others.select("ra", "dec")), "others")
    a1, b1 = _boxes(a, ["_zone", "_cell", "cell1"], "a"), _boxes(b, ["_zone", "_cell", "cell1"], "b")
    around = a1.withColumn("zone", F.explode(F.array(F.col("a__zone") - 1, F.col("a__zone"), F.col("a__zone") + 1))).withColumn("cells", _cells_in_zone(F.col("zone"), height, radius_deg))
    # All cells that any member of the box may reach.
    first, last = _cell("a_ra0", F.col("cells")) - 1, _cell("a_ra1", F.col("cells")) + 1
    around = around.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("cells") - 1)), lambda c: F.pmod(c, F.col("cells"))))))
    met = around.join(b1.withColumnRenamed("b__zone", "zone").withColumnRenamed("b__cell", "cell"), ["zone", "cell"])

    def sorted_out(pairs: DataFrame) -> DataFrame:
        """Pairs of boxes that may be within the radius, and whether they wholly are."""
        away, reach, slack = separation_deg("a_ra", "a_dec", "b_ra", "b_dec"), F.col("a_far") + F.col("b_far"), 1e-9
        near = pairs.withColumn("away", away).where(F.col("away") - reach <= radius_deg + slack)
        return near.withColumn("whole", F.col("away") + reach <= radius_deg - slack).withColumn("pairs", F.col("a_n") * F.col("b_n"))

    met = durable(sorted_out(met).select("a_cell1", "b_cell1", "b_n", "pairs", "whole"), "cells")
    a2, b2 = _boxes(a, ["cell1", "cell2"], "a"), _boxes(b, ["cell1", "cell2"], "b")
    deep = met.where(~F.col("whole") & (F.col("pairs") > FEW_PAIRS)).select("a_cell1", "b_cell1")
    finer = durable(sorted_out(deep.join(a2, "a_cell1").join(b2, "b_cell1")).select("a_cell2", "b_cell2", "b_n", "pairs", "whole"), "cells")

    def one_by_one(cut: DataFrame, level: str) -> DataFrame:
        right = b.select(F.col(level).alias(f"b_{level}"), F.col("ra").alias("b_ra"), F.col("dec").alias("b_dec"))
        pairs = cut.select(f"a_{level}", f"b_{level}").join(a.select("row", "ra", "dec", F.col(level).alias(f"a_{level}")), f"a_{level}").join(right, f"b_{level}")
        near = pairs.where(F.abs(F.col("dec") - F.col("b_dec")) <= radius_deg + 1e-9).where(separation_deg("ra", "dec", "b_ra", "b_dec") <= radius_deg)
        return near.groupBy("row").agg(F.count("*").alias("n"))

    def added(level_pairs: DataFrame, level: str) -> DataFrame:
        summed = level_pairs.where("whole").groupBy(F.col(f"a_{level}").alias(level)).agg(F.sum("b_n").alias("n"))
        return a.select("row", level).join(summed, level).drop(level)

    looked_into = met.where(~F.col("whole") & (F.col("pairs") <= FEW_PAIRS))
    parts = [added(met, "cell1"), added(finer, "cell2"), one_by_one(looked_into, "cell1"), one_by_one(finer.where(~F.col("whole")), "cell2")]
    return reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n").alias("n"))


def crowding(points: DataFrame, radius_deg: float) -> float:
    """Rows that a point meets in a positional join, on average: nine cells' worth of its own cell."""
    height = max(radius_deg, LEAST_ZONE)
    cells = _placed(points.select("ra", "dec"), height, False, radius_deg).groupBy("_zone", "_cell").agg(F.count("*").cast("double").alias("n"))
    mean = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    return 9 * (mean or 0.0)


def _tile_height(others: DataFrame, radius_deg: float) -> float:
    """Height (degrees) of tiles that hold about ``TILE_ROWS`` rows where most rows are; four radii at least, so that few rows are copied."""
    least = max(LEAST_TILE * radius_deg, LEAST_ZONE)
    cells = others.groupBy(F.floor("dec").alias("d"), F.floor(F.col("ra") * F.cos(F.radians("dec"))).alias("r")).agg(F.count("*").cast("double").alias("n"))
    per_degree = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return max(least, min(MOST_TILE, math.sqrt(TILE_ROWS / per_degree) if per_degree else MOST_TILE))


def _in_tiles(points: DataFrame, radius_deg: float) -> tuple[DataFrame, DataFrame | None]:
    """(rows of a table copied to the tiles (_zone, _cell) within the radius, ``_mine`` in their own; rows of tiles too full for a task, or None)."""
    points = points.where("ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec)")
    keys, height = ["_zone", "_cell"], _tile_height(points, radius_deg)
    placed = _placed(points, height, True, radius_deg)
    home = (F.col("_zone") == F.floor((F.col("dec") + 90) / height)) & (F.col("_cell") == _cell("ra", F.col("_n")))
    east = F.pmod(F.col("ra") - (F.col("_cell") + 0.5) * 360.0 / F.col("_n") + 180.0, F.lit(360.0)) - 180.0
    placed = placed.withColumn("_mine", home).withColumn("_east", east).drop("_wide", "_n")
    full = durable(placed.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= FULL_TILE).select(*keys), "full")
    if full.isEmpty():
        return placed, None
    return placed.join(full, keys, "left_anti"), placed.where("_mine").join(full, keys, "left_semi").select(*points.columns)


def counts_in_radii(points: DataFrame, radii: list[float], key: str = "source_id") -> DataFrame:
    """(key, n0, n1, ...): rows of the same table within each of the radii (rising) of a row, itself among them; rows of one key are summed.

    Rows meet in tiles, larger than the radius, where whole stretches of a strip are counted by search (``tiles.counts``); a row costs the
    rim of its circle, not its area. Tiles that are too full for a task are counted by the pyramid. Pairs nearer to a radius
    than ``tiles.TIE`` are told by Spark's own separation.
    """
    names = [f"n{i}" for i in range(len(radii))]
    if not LEAST_RADIUS <= radii[0] <= radii[-1] <= WIDE or crowding(points, radii[-1]) < CROWDED:
        s = points.select(key, "ra", "dec")
        return sky_join(s, s, radii[-1], key=key).groupBy(key).agg(*(F.count_if(F.col("sep_deg") <= r).alias(f"n{i}") for i, r in enumerate(radii)))
    s = points.where("ra IS NOT NULL AND dec IS NOT NULL").select(key, "ra", "dec")
    placed, rest = _in_tiles(s, radii[-1])
    of_key = s.schema[key].dataType.simpleString()
    schema = f"`{key}` {of_key}, {', '.join(f'{n} long' for n in names)}, _radius int, ra double, dec double, ra_b double, dec_b double"

    def count(tile: pa.Table) -> pa.Table:
        mine = np.flatnonzero(tile.column("_mine").to_numpy())
        ra, dec, east = (tile.column(c).to_numpy() for c in ("ra", "dec", "_east"))
        keys, found, close = tile.column(key).combine_chunks(), [], []
        for i, r in enumerate(radii):
            n, point, other = tiles.counts(east[mine], dec[mine], east, dec, r)
            found.append(n)
            close.append((np.full(len(point), i), mine[point], other))
        which, at, other = (np.concatenate(x) for x in zip(*close, strict=True))
        blank = pa.nulls(len(mine), pa.float64())
        columns = [pa.chunked_array([keys.take(pa.array(mine)), keys.take(pa.array(at))])]
        columns += [pa.chunked_array([pa.array(n), pa.nulls(len(at), pa.int64())]) for n in found]
        columns.append(pa.chunked_array([pa.nulls(len(mine), pa.int32()), pa.array(which, pa.int32())]))
        columns += [pa.chunked_array([blank, pa.array(x)]) for x in (ra[at], dec[at], ra[other], dec[other])]
        return pa.table(columns, names=[key, *names, "_radius", "ra", "dec", "ra_b", "dec_b"])

    counted = placed.groupBy("_zone", "_cell").applyInArrow(count, schema)
    sep = separation_deg("ra", "dec", "ra_b", "dec_b")
    out = counted.groupBy(key).agg(*((F.coalesce(F.sum(f"n{i}"), F.lit(0)) + F.count_if((F.col("_radius") == i) & (sep <= r))).alias(f"n{i}") for i, r in enumerate(radii)))
    if rest is None:
        return out
    rest = durable(rest.withColumn("row", F.monotonically_increasing_id()), "points")
    more = rest.select(key, "row")
    for i, r in enumerate(radii):
        more = more.join(counts_within(rest, s, r).withColumnRenamed("n", f"n{i}"), "row")
    return out.unionByName(more.drop("row")).groupBy(key).agg(*(F.sum(n).alias(n) for n in names))


def _same_id(ids: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``mine``, row) of rows with one id."""
    order = np.argsort(ids, kind="stable")
    known = ids[order]
    first, last = np.searchsorted(known, ids[mine], "left"), np.searchsorted(known, ids[mine], "right")
    size = last - first
    at = np.repeat(np.arange(len(mine)), size)
    return at, order[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]


def _context_in_tiles(placed: DataFrame, radius_deg: float) -> DataFrame:
    """(source_id, local_density, matched_catalogs) of rows in tiles (source_id, own, catalog, ...), whose neighbours are counted by catalog."""
    schema = "source_id string, n long, catalogs array<string>, ra double, dec double, ra_b double, dec_b double, catalog_b string"
    nothing = np.empty(0, np.int64)

    def count(tile: pa.Table) -> pa.Table:
        mine = np.flatnonzero(tile.column("_mine").to_numpy())
        ra, dec, east = (tile.column(c).to_numpy() for c in ("ra", "dec", "_east"))
        ids, catalog = (tile.column(c).combine_chunks().dictionary_encode() for c in ("source_id", "catalog"))
        names, code, which = catalog.dictionary, catalog.indices.to_numpy(), ids.indices.to_numpy()
        own = pc.index_in(tile.column("own").combine_chunks(), names).fill_null(-1).to_numpy()[mine]
        same, twin = _same_id(which, mine)
        inside = tiles.within(east[mine[same]], dec[mine[same]], east[twin], dec[twin], radius_deg)
        same, twin = same[inside], twin[inside]
        total, met, close = np.zeros(len(mine), np.int64), [(nothing, nothing)], [(nothing, nothing)]
        for c in range(len(names)):
            some = np.flatnonzero(code == c)
            n, point, other = tiles.counts(east[mine], dec[mine], east[some], dec[some], radius_deg)
            n -= np.bincount(same[code[twin] == c], minlength=len(mine))  # rows of its own id are no neighbours of a row
            total += n
            seen = np.flatnonzero((n > 0) & (own != c))
            met.append((seen, np.full(len(seen), c)))
            other = some[other]
            apart = which[mine[point]] != which[other]
            close.append((point[apart], other[apart]))
        (row, name), (point, other) = (map(np.concatenate, zip(*x, strict=True)) for x in (met, close))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(mine)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(name[np.argsort(row, kind="stable")])))
        kept, at = np.flatnonzero(total), mine[point]
        id_of = lambda rows: ids.dictionary.take(pa.array(which[rows]))
        met_at = pc.if_else(pa.array(own[point] == code[other]), None, names.take(pa.array(code[other])))
        counted = [id_of(mine[kept]), pa.array(total[kept]), lists.take(pa.array(kept)), *(pa.nulls(len(kept), pa.float64()) for _ in range(4)), pa.nulls(len(kept), pa.string())]
        told = [id_of(at), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), lists.type), *map(pa.array, (ra[at], dec[at], ra[other], dec[other])), met_at]
        return pa.table([pa.chunked_array([x, y.cast(x.type)]) for x, y in zip(counted, told, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    near = separation_deg("ra", "dec", "ra_b", "dec_b") <= radius_deg
    counted = placed.groupBy("_zone", "_cell").applyInArrow(count, schema).withColumn("near", near)
    names = F.concat(F.flatten(F.collect_list("catalogs")), F.collect_set(F.when(F.col("near"), F.col("catalog_b"))))
    density = F.coalesce(F.sum("n"), F.lit(0).cast("long")) + F.count_if("near")
    return counted.groupBy("source_id").agg(density.alias("local_density"), F.array_sort(F.array_distinct(names)).alias("matched_catalogs"))


def _context_by_pairs(candidates: DataFrame, pool: DataFrame, radius_deg: float) -> DataFrame:
    near = sky_join(candidates.select("source_id", "ra", "dec", "own"), pool.select("source_id", "ra", "dec", "catalog"), radius_deg).where("source_id <> source_id_b")
    return near.groupBy("source_id").agg(F.count("*").alias("local_density"), F.array_sort(F.collect_set(F.when(F.col("catalog_b") != F.col("own"), F.col("catalog_b")))).alias("matched_catalogs"))


def neighbour_context(candidates: DataFrame, pool: DataFrame, radius_deg: float = 0.08) -> DataFrame:
    """Add local_density (pool rows around, itself apart) and matched_catalogs (other catalogs among them).

    A null catalog is GAIA for the candidate and UNKNOWN for its neighbour. A table among itself is counted in tiles, by catalog, without
    a row for each pair; tiles too full for a task, and candidates of another table than the pool, are joined pair by pair.
    """
    own = normalize_catalog("catalog_source").alias("own")
    other = normalize_catalog("catalog_source", "UNKNOWN").alias("catalog")  # once a row, not once a pair
    text = F.col("source_id").cast("string").alias("source_id")
    if candidates is pool and LEAST_RADIUS <= radius_deg <= WIDE:
        s = pool.where("source_id IS NOT NULL").select(text, "ra", "dec", own, other)
        placed, rest = _in_tiles(s, radius_deg)
        context = _context_in_tiles(placed, radius_deg)
        if rest is not None:
            # An id may have rows in both; what it met is brought together.
            both = context.unionByName(_context_by_pairs(durable(rest, "points"), s, radius_deg)).groupBy("source_id")
            context = both.agg(F.sum("local_density").alias("local_density"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_catalogs")))).alias("matched_catalogs"))
        context = context.withColumn("source_id", F.col("source_id").cast(pool.schema["source_id"].dataType))
    else:
        context = _context_by_pairs(candidates.select("source_id", "ra", "dec", own), pool.select("source_id", "ra", "dec", other), radius_deg)
    return candidates.join(context, "source_id", "left").withColumn("local_density", F.coalesce("local_density", F.lit(0).cast("long"))).withColumn("matched_catalogs", F.coalesce("matched_catalogs", F.array().cast("array<string>")))


def catalog_overlap(stars: DataFrame, match_arcsec: float = 3.0) -> DataFrame:
    """(c1, c2, matches, fraction) of every two catalogs, c1 < c2: rows of c1 with a match in c2, over the smaller catalog; 0 where none has."""
    named = stars.select("source_id", "ra", "dec", normalize_catalog("catalog_source", "UNKNOWN").alias("catalog"))
    size = named.groupBy("catalog").agg(F.count("*").alias("n"))
    met = sky_join(named, named, match_arcsec / 3600, zone=SPARSE_ZONE).where("catalog < catalog_b").groupBy(F.col("catalog").alias("c1"), F.col("catalog_b").alias("c2")).agg(F.countDistinct("source_id").alias("matches"))
    names = size.agg(F.collect_list("catalog").alias("names"))  # one row, a few names
    every = names.select(F.explode("names").alias("c1"), "names").select("c1", F.explode("names").alias("c2")).where("c1 < c2")
    n1, n2 = size.select(F.col("catalog").alias("c1"), F.col("n").alias("n1")), size.select(F.col("catalog").alias("c2"), F.col("n").alias("n2"))
    pairs = every.join(met, ["c1", "c2"], "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return pairs.join(n1, "c1").join(n2, "c2").select("c1", "c2", "matches", (F.col("matches") / F.least("n1", "n2")).alias("fraction"))


def catalog_unique(stars: DataFrame, match_arcsec: float = 3.0) -> DataFrame:
    """(catalog, unique_count) of every catalog: rows without a match in any other; 0 where all have one."""
    named = stars.select("source_id", "ra", "dec", normalize_catalog("catalog_source", "UNKNOWN").alias("catalog"))
    placed = named.where("ra IS NOT NULL AND dec IS NOT NULL")
    matched = sky_join(placed, placed, match_arcsec / 3600, zone=SPARSE_ZONE).where("catalog <> catalog_b").select("source_id").distinct()
    alone = placed.join(matched, "source_id", "left_anti").groupBy("catalog").agg(F.count("*").alias("unique_count"))
    return named.select("catalog").distinct().join(alone, "catalog", "left").select("catalog", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count"))


def overlap_report(stars: DataFrame, match_arcsec: float = 3.0) -> DataFrame:
    """One row: all stars, those not unique to their catalog (stars without a position among them), and their share to three places."""
    alone = catalog_unique(stars, match_arcsec).agg(F.coalesce(F.sum("unique_count"), F.lit(0).cast("long")).alias("alone"))
    out = stars.agg(F.count("*").alias("total_stars")).join(F.broadcast(alone)).withColumn("multi_detected", F.col("total_stars") - F.col("alone")).drop("alone")
    return out.withColumn("multi_fraction", F.round(F.coalesce(F.try_divide("multi_detected", "total_stars"), F.lit(0.0)), 3))


def multi_catalog(stars: DataFrame, n: int = 2, radius_deg: float = 0.08) -> DataFrame:
    """Stars seen in at least ``n`` catalogs."""
    return neighbour_context(stars, stars, radius_deg).where(F.size("matched_catalogs") + 1 >= n)


def _inside(points: DataFrame, areas: DataFrame, reach: str) -> DataFrame:
    """Pairs of points and areas (region, region_ra, region_dec, ...) with the point within the area's ``reach``.

    A small area table is broadcast. A larger one is parted by the power of two above the reach, a handful of
    parts, and each part is an equi-join on zones and cells of that size.
    """
    if areas.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return points.join(F.broadcast(areas), in_cone("ra", "dec", "region_ra", "region_dec", reach))
    size = F.ceil(F.log2(F.greatest(F.col(reach), F.lit(LEAST_ZONE))))
    parts = [points.join(F.broadcast(areas.limit(0)), in_cone("ra", "dec", "region_ra", "region_dec", reach))]
    for k in (r[0] for r in areas.where(F.col(reach) >= 0).select(size).distinct().collect()):
        own = areas.where(size == k).withColumn("ra", F.col("region_ra")).withColumn("dec", F.col("region_dec"))
        near = sky_join(own, points, 2.0**k, sep="_sep").where(F.col("_sep") <= F.col(reach))
        parts.append(near.select(*(F.col(f"{c}_b").alias(c) for c in points.columns), *areas.columns))
    return reduce(DataFrame.union, parts)


def region_members(stars: DataFrame, regions: DataFrame) -> DataFrame:
    """Every (star, region) with the star inside the region; a star may be in several."""
    r = regions.select(F.col("name").alias("region"), F.col("ra").alias("region_ra"), F.col("dec").alias("region_dec"), "radius_deg")
    return _inside(stars, r, "radius_deg")


def nearest_region(points: DataFrame, regions: DataFrame, key: str = "source_id") -> DataFrame:
    """Add label: the nearest region within the larger of 1.9 radii and 4 degrees, else ML Cluster."""
    r = regions.select(F.col("name").alias("region"), F.col("ra").alias("region_ra"), F.col("dec").alias("region_dec"), F.greatest(1.9 * F.col("radius_deg"), F.lit(4.0)).alias("reach"))
    near = _inside(points, r, "reach")
    sep = separation_deg("ra", "dec", "region_ra", "region_dec")
    label = near.groupBy(key).agg(F.min(F.struct(sep.alias("sep"), F.col("region"))).alias("best")).select(key, F.col("best.region").alias("label"))
    return points.join(label, key, "left").withColumn("label_source", F.when(F.col("label").isNotNull(), "region").otherwise("data")).withColumn("label", F.coalesce("label", F.lit("ML Cluster")))


def nearest_matches(a: DataFrame, b: DataFrame, arcsec: float, k: int = 1, key: str = "source_id", b_key: str = "source_id", within=()) -> DataFrame:
    """For each row of ``a`` its ``k`` nearest rows of ``b``, with separation_arcsec and rank."""
    order = Window.partitionBy(key, *within).orderBy("sep_deg", F.col(f"{b_key}_b"))
    pairs = sky_join(a, b, arcsec / 3600, key=key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("separation_arcsec", F.col("sep_deg") * 3600)


def alert_matches(alerts: DataFrame, stars: DataFrame, arcsec: float = 3.0, k: int = 5) -> DataFrame:
    """The nearest stars of each alert, with the true separation and the radius that was searched."""
    return nearest_matches(alerts, stars.select("source_id", "ra", "dec"), arcsec, k, key="name").withColumn("match_radius_arcsec", F.lit(float(arcsec)))


def xmatch_catalogs(stars: DataFrame, catalogs: dict[str, DataFrame], arcsec: float = 2.0, k: int = 5) -> DataFrame:
    """(source_id, catalog, matches): up to ``k`` nearest rows of each external catalog table (source_id, ra, dec, ...)."""
    found = []
    for name, table in sorted(catalogs.items()):
        near = nearest_matches(stars.select("source_id", "ra", "dec"), table, arcsec, k)
        fields = F.struct("rank", "separation_arcsec", F.col("source_id_b").alias("match_id"))
        found.append(near.groupBy("source_id").agg(F.array_sort(F.collect_list(fields)).alias("matches")).withColumn("catalog", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def cross_register(stars: DataFrame, authority: DataFrame, arcsec: float = 5.0) -> DataFrame:
    """Add validated, main_id and otype of the nearest object of an authority table (main_id, ra, dec, otype)."""
    near = nearest_matches(stars.select("source_id", "ra", "dec"), authority, arcsec, 1, b_key="main_id")
    best = near.select("source_id", F.col("main_id_b").alias("main_id"), F.col("otype_b").alias("otype"))
    return stars.join(best, "source_id", "left").withColumn("validated", F.col("main_id").isNotNull())


def resolve_names(names: DataFrame, stars: DataFrame, authority: DataFrame, arcsec: float = 5.0) -> DataFrame:
    """(name, source_id, separation_arcsec): names looked up in (name, ra, dec), then the nearest star."""
    known = names.select(F.lower(F.trim("name")).alias("name")).distinct().join(authority.select(F.lower("name").alias("name"), "ra", "dec").dropDuplicates(["name"]), "name")
    return nearest_matches(known, stars.select("source_id", "ra", "dec"), arcsec, 1, key="name").select("name", F.col("source_id_b").alias("source_id"), "separation_arcsec")


def match_fields(stars: DataFrame, fields: DataFrame, arcsec: float = 5.0) -> DataFrame:
    """Catalog stars at the positions of a field table (field, ra, dec)."""
    return nearest_matches(fields, stars.select("source_id", "ra", "dec"), arcsec, 1, key="field")


def with_ebv(stars: DataFrame, grid: DataFrame | None = None, step: float = 1.0) -> DataFrame:
    """Add ebv from a user's grid (ra, dec, ebv of each cell's corner), 0.05 where it has none."""
    if grid is None:
        return stars.withColumn("ebv", F.lit(0.05))
    cell = lambda c: F.floor(F.col(c) / step)
    table = grid.groupBy(cell("ra").alias("_ra"), cell("dec").alias("_dec")).agg(F.avg("ebv").alias("ebv"))
    return stars.withColumn("_ra", cell("ra")).withColumn("_dec", cell("dec")).join(table, ["_ra", "_dec"], "left").drop("_ra", "_dec").withColumn("ebv", F.coalesce("ebv", F.lit(0.05)))
