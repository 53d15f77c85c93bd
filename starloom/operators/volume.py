"""Stars in three dimensions: display projection, k-means, named clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.sky import distance_pc, light_years, to_cartesian
from starloom.functions.stellar import bp_rp
from starloom.operators.cone import volume_filter
from starloom.operators.crossmatch import region_members
from starloom.plans.durable import durable


def space_volume(stars: DataFrame, limit: int | None = 8000, min_parallax: float | None = None, mag_limit: float | None = None) -> DataFrame:
    """Stars with parallax as points in parsec, y up."""
    df = volume_filter(stars, limit, min_parallax, mag_limit).withColumn("distance_pc", distance_pc("parallax"))
    x, y, z = to_cartesian("ra", "dec", "distance_pc")
    return df.withColumn("x_pc", x).withColumn("y_pc", y).withColumn("z_pc", z).withColumn("distance_ly", light_years("distance_pc")).withColumn("bp_rp", bp_rp())


def display_projection(points: DataFrame, exact: bool = True) -> DataFrame:
    """Distances compressed beyond an anchor, the larger of their 55th percentile and 25; the far 4 percent are capped.

    ``exact`` percentiles sort all points; the approximate ones are for very many.
    """
    q = (lambda p: F.percentile("distance_pc", F.lit(p))) if exact else (lambda p: F.percentile_approx("distance_pc", p, 10_000))
    scale = points.agg(q(0.96).alias("_far"), F.greatest(q(0.55), F.lit(25.0)).alias("_anchor"))  # one row
    df = points.join(F.broadcast(scale))
    d = F.least("distance_pc", "_far")
    shown = F.col("_anchor") * F.log1p(d / F.col("_anchor"))
    for axis in "xyz":
        df = df.withColumn(f"display_{axis}_pc", F.col(f"{axis}_pc") / F.col("distance_pc") * shown)
    return df.drop("_far", "_anchor")


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """The linearly interpolated percentile of a column, exactly, without sorting it or holding its values.

    A sketch gives a bracket; one more pass counts what lies below it and checks that the wanted ranks are inside; only the
    rows of the bracket are ordered. A bracket that misses is widened. Null if there is no value.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    if n == 0:
        return None
    place = p * (n - 1)
    first, width = int(place), 1e-3
    while True:
        ends = [max(0.0, p - width), min(1.0, p + width)]
        lo, hi = values.agg(F.percentile_approx("v", ends, 10_000)).first()[0]
        below, upto = values.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
        if (below <= first or ends[0] == 0.0) and (upto >= min(n, first + 2) or ends[1] == 1.0):
            break
        width *= 8
    inside = values.where(F.col("v") >= lo) if ends[1] == 1.0 else values.where((F.col("v") >= lo) & (F.col("v") <= hi))
    inside, below = (values.where("true"), 0) if ends[0] == 0.0 else (inside, below)
    # Equal values are one row with their number, so that ties of any size stay small.
    found, at = [], below
    for r in inside.groupBy("v").count().orderBy("v").toLocalIterator():
        while len(found) < 2 and first + len(found) < at + r["count"]:
            found.append(r.v)
        at += r["count"]
        if len(found) == 2:
            break
    return found[0] + (found[-1] - found[0]) * (place - first)


def kmeans3d(points: DataFrame, k: int = 3, max_iter: int = 12, seeding: str = "farthest", seed: int = 42) -> DataFrame:
    """Add cluster (0 to k-1): Lloyd's rounds on display position and scaled motion over all points.

    ``seeding`` is ``farthest`` (the point of largest norm, then the farthest from the centres so far) or ``parallel``
    (k-means||, a few passes for any k). The driver holds k centres, the data stay in place. Fewer than three points give none.
    """
    axes = ["display_x_pc", "display_y_pc", "display_z_pc"]
    moves = points.select(F.explode(F.array(F.abs("pmra"), F.abs("pmdec"))).alias("m")).where("m IS NOT NULL")
    scale = max(exact_percentile(moves, "m", 0.75) or 1.0, 1.0)
    made = [F.col(a) for a in axes] + [F.coalesce(m, F.lit(0.0)) / scale * 0.18 for m in ("pmra", "pmdec")]
    data = durable(points.where(" AND ".join(f"{a} IS NOT NULL" for a in axes)).withColumn("_f", F.array(*made)), "kmeans")
    n = data.count()
    if n < 3:
        return data.withColumn("cluster", F.lit(0)).limit(0).drop("_f")
    k = max(1, min(k, n))

    def d2(centre: list[float]):
        return F.aggregate(F.zip_with("_f", F.lit(centre), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    norm = F.aggregate(F.slice("_f", 1, 3), F.lit(0.0), lambda s, v: s + v * v)
    if seeding == "parallel":
        centres = parallel_seeds(data, k, seed)
    else:
        centres = [list(data.orderBy(F.desc(norm), "source_id").first()["_f"])]
    while seeding != "parallel" and len(centres) < k:
        far = data.orderBy(F.desc(F.least(*(d2(c) for c in centres)) if len(centres) > 1 else d2(centres[0])), "source_id").first()["_f"]
        if list(far) in centres:
            break
        centres.append(list(far))

    def nearest(cs: list):
        return F.array_min(F.array(*(F.struct(d2(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(cs))))["i"]

    for _ in range(max_iter):
        means = data.withColumn("c", nearest(centres)).groupBy("c").agg(*(F.avg(F.get("_f", F.lit(j))).alias(f"m{j}") for j in range(5))).collect()  # k rows
        after = list(centres)
        for r in means:
            after[r.c] = [r[f"m{j}"] for j in range(5)]
        if after == centres:
            break
        centres = after
    return data.withColumn("cluster", nearest(centres)).drop("_f")


def parallel_seeds(data: DataFrame, k: int, seed: int, column: str = "_f") -> list[list[float]]:
    """Starting centres by scalable k-means++ over all rows; fewer than ``k`` where there are fewer distinct rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="v", initMode="k-means||", initSteps=2, maxIter=0).fit(data.select(array_to_vector(column).alias("v"))) if k > 1 else None
    if model is None:
        return [list(data.agg(F.array(*(F.avg(F.get(column, F.lit(j))) for j in range(5)))).first()[0])]
    return sorted([float(x) for x in c] for c in model.clusterCenters())


def label_clusters(assigned: DataFrame, regions: DataFrame) -> DataFrame:
    """(cluster, n, label): clusters of max(18, 2.5 percent) members or more, named after the region with most of them.

    A region needs max(12, 24 percent) of the members within max(1.7 radii, 3 degrees), and is used once, by
    the largest cluster first; the greedy choice runs over at most clusters x regions rows.
    """
    total = assigned.count()
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= max(18, int(total * 0.025)))
    wide = regions.withColumn("radius_deg", F.greatest(1.7 * F.col("radius_deg"), F.lit(3.0)))
    inside = region_members(assigned, wide).groupBy("cluster", "region").agg(F.count("*").alias("k"))
    options = sizes.join(inside, "cluster").where(F.col("k") >= F.greatest(F.lit(12.0), 0.24 * F.col("n"))).orderBy(F.desc("n"), "cluster", F.desc("k"), "region").collect()
    taken: dict[int, str] = {}
    for r in options:
        if r.cluster not in taken and r.region not in taken.values():
            taken[r.cluster] = r.region
    names = assigned.sparkSession.createDataFrame(list(taken.items()), "cluster int, label string")
    return sizes.join(names, "cluster", "left").withColumn("label", F.coalesce("label", F.lit("ML Cluster")))


def nearest_track(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Add track and color_residual: the fiducial point nearest in magnitude and colour; the points of the tracks are literals of the row's expression."""
    fixed = [F.struct((F.pow(F.col("abs_mag") - F.lit(t.track_mag), 2) + F.pow(F.col("color") - F.lit(t.track_color), 2)).alias("off"), F.lit(t.track).alias("track"), (F.col("color") - F.lit(t.track_color)).alias("residual")) for t in tracks.collect()]  # published sequences
    best = points.where("abs_mag IS NOT NULL AND color IS NOT NULL").withColumn("_b", F.array_min(F.array(*fixed)))
    return best.withColumn("track", F.col("_b.track")).withColumn("color_residual", F.col("_b.residual")).drop("_b")


# Fixed values: (BP-RP, M_G) along published sequences.
TRACKS = {
    "ZAMS": [(-0.33, -4.5), (-0.20, -2.0), (-0.07, 0.6), (0.22, 1.9), (0.44, 2.7), (0.58, 3.4), (0.73, 4.4), (0.94, 5.3), (1.30, 6.6), (1.80, 8.6), (2.50, 10.5), (3.20, 12.8), (3.90, 15.0)],
    "RGB": [(0.82, 3.5), (0.92, 3.2), (1.02, 2.7), (1.12, 2.0), (1.25, 1.2), (1.40, 0.5), (1.55, -0.3), (1.70, -1.2), (1.90, -2.0)],
    "WD": [(-0.40, 10.0), (-0.20, 10.5), (0.00, 11.0), (0.15, 11.5), (0.30, 12.0), (0.50, 12.8), (0.70, 13.5), (1.00, 14.5), (1.30, 15.5)],
    "HB": [(-0.15, 0.5), (0.10, 0.6), (0.40, 0.6), (0.60, 0.65), (0.80, 0.7), (1.00, 0.75)],
}


def fiducial_tracks(spark) -> DataFrame:
    return spark.createDataFrame([(t, i, float(c), float(m)) for t, ps in TRACKS.items() for i, (c, m) in enumerate(ps)], "track string, point_no int, track_color double, track_mag double")


