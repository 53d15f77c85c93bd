"""Approximate vector search by an inverted file: coarse cells, residual codes, and an exact second look.

An index is a folder::

    centres   (cell, centre)                       k-means over all unit vectors
    rows      cell=<n>/ (id, code, step, vector)   one row a vector; the code is its residual in steps, a byte each
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from starloom.operators.vectors import StatedQueries, best_pairs, query_blocks, unit_rows
from starloom.plans.durable import durable

#: Most cells of an index, whatever the table; their centres are broadcast.
MOST_CELLS = 4096


def _coded(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cell, code, step, vector) of (id, vector): the nearest centre, and what is left in steps of a byte."""
    fields = vectors.schema
    schema = StructType([fields["id"], StructField("cell", IntegerType()), StructField("code", BinaryType()), StructField("step", DoubleType()), fields["vector"]])

    def code(batches):
        for batch in batches:
            rows, x = unit_rows(batch.column("vector"), centres.shape[1])
            cell = (x @ centres.T).argmax(1) if len(x) else np.empty(0, np.int64)
            rest = x - centres[cell]
            step = np.maximum(np.abs(rest).max(1, initial=0), 1e-12) / 127
            codes = np.rint(rest / step[:, None]).astype(np.int8)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column("id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), kept.column("vector")], schema.names)

    return vectors.select("id", "vector").mapInArrow(code, schema)


def build_index(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> str:
    """Index all of (id, vector) under ``path``: vectors that have a direction and the dimension that most have.

    Centres come from k-means with scalable seeding over all unit vectors; by default the square root of their number.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    good = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    sizes = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        raise ValueError("no vector to index")
    usable = good.where((F.size("vector") == sizes.dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    k = max(1, min(MOST_CELLS, cells or round(math.sqrt(sizes["count"]))))
    fit = usable.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    model = KMeans(k=k, seed=seed, featuresCol="v", distanceMeasure="cosine", initMode="k-means||", maxIter=10).fit(fit) if k > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.zeros((1, sizes.dim))
    length = np.sqrt((centres**2).sum(1, keepdims=True))
    centres = np.divide(centres, length, out=np.zeros_like(centres), where=length > 0)
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _coded(usable, centres).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return path


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # MOST_CELLS at most


def add_to_index(path: str, docs: DataFrame) -> None:
    """Put (id, vector) into the index, replacing ids that are there: only the cells that lose or gain a row are written again.

    Of rows that repeat an id the one of the greatest vector stays.
    """
    spark = docs.sparkSession
    one = docs.groupBy("id").agg(F.max("vector").alias("vector"))
    new = durable(_coded(one.select("id", F.col("vector").cast(spark.read.parquet(f"{path}/rows").schema["vector"].dataType).alias("vector")), _centres(spark, path)), "new")
    rows = spark.read.parquet(f"{path}/rows")
    touched = rows.join(new.select("id"), "id", "left_semi").select("cell").union(new.select("cell")).distinct()
    kept = rows.join(F.broadcast(touched), "cell", "left_semi").join(new.select("id"), "id", "left_anti")
    after = durable(kept.select(new.columns).unionByName(new), "cells")  # written apart: the cells are read while they are made
    gone = [r.cell for r in touched.join(after.select("cell").distinct(), "cell", "left_anti").collect()]  # cells left empty
    after.repartition("cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/rows")
    if gone:
        files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
        for cell in gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/cell={cell}"), True)


def _probes(centres: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    """The nearest cells of each query."""
    return np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :nprobe]


def search_index(spark: SparkSession, path: str, queries: DataFrame | StatedQueries, k: int = 10, nprobe: int = 8, refine: int = 4) -> DataFrame:
    """(query_id, id, score, rank): near neighbours by cosine from the ``nprobe`` nearest cells of each query.

    Only those cells are read, without their vectors; codes give ``refine * k`` candidates a query, whose vectors are then
    compared exactly. All cells and a large ``refine`` give the exact result.
    """
    rows, centres = spark.read.parquet(f"{path}/rows"), _centres(spark, path)
    names = [rows.schema["id"], StructField("score", DoubleType())]
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), *names])
    out = spark.createDataFrame([], schema)
    for ids, q in query_blocks(queries):
        if q.shape[1] != centres.shape[1]:
            continue
        probes = _probes(centres, q, nprobe)
        shared = spark.sparkContext.broadcast((ids, q, probes, centres))

        def scan(batches, shared=shared):
            ids, q, probes, centres = shared.value
            least = np.full(len(q), -np.inf)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell):
                    asked = np.flatnonzero((probes == c).any(1))
                    if not len(asked):
                        continue
                    part = batch.filter(pa.array(cell == c))
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(part.num_rows, -1)
                    x = centres[c] + codes * part.column("step").to_numpy()[:, None]
                    bar = least[asked]
                    row, col, score = best_pairs(x, part.column("id"), q[asked], bar, refine * k)
                    least[asked] = bar
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked[col])), part.column("id").take(pa.array(row)), pa.array(score)], schema.names)

        wanted = rows.select("id", "code", "step", "cell").where(F.col("cell").isin(np.unique(probes).tolist()))
        near = wanted.mapInArrow(scan, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= refine * k).select("query_id", "id")

        def again(batches, shared=shared):
            ids, q, *_ = shared.value
            place = {v: i for i, v in enumerate(ids.to_pylist())}
            for batch in batches:
                at, x = unit_rows(batch.column("vector"), q.shape[1])
                asked = batch.column("query_id").take(pa.array(at))
                mine = q[[place[v] for v in asked.to_pylist()]] if len(at) else q[:0]
                yield pa.RecordBatch.from_arrays([asked, batch.column("id").take(pa.array(at)), pa.array((x * mine).sum(1))], schema.names)

        out = out.unionByName(chosen.join(rows.select("id", "vector"), "id").select("query_id", "id", "vector").mapInArrow(again, schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pairs_compared(spark: SparkSession, path: str, queries: DataFrame | StatedQueries, k: int = 10, nprobe: int = 8, refine: int = 4) -> dict:
    """What a search costs: all pairs, pairs of codes and exact pairs (at most)."""
    size = dict(spark.read.parquet(f"{path}/rows").groupBy("cell").count().collect())
    centres, coded, n = _centres(spark, path), 0, 0
    for ids, q in query_blocks(queries):
        n += len(ids)
        coded += sum(size.get(int(c), 0) for c in _probes(centres, q, nprobe).ravel())
    return {"all": n * sum(size.values()), "coded": coded, "exact": min(coded, n * refine * k)}


def tuned_nprobe(spark: SparkSession, path: str, queries: DataFrame | StatedQueries, k: int = 10, recall: float = 0.9, refine: int = 4) -> tuple[int, float]:
    """(nprobe, measured recall): the least power of two of probed cells whose recall over the stated queries reaches ``recall``.

    Held against an exact search of the index's own vectors; all cells are the last resort.
    """
    from starloom.operators.vectors import vector_topk

    queries = queries if isinstance(queries, StatedQueries) else StatedQueries(queries)  # searched once for each nprobe
    exact = durable(vector_topk(spark.read.parquet(f"{path}/rows").select("id", "vector"), queries, k).select("query_id", "id"), "exact")
    total, cells, nprobe = exact.count(), len(_centres(spark, path)), 1
    while True:
        hits = search_index(spark, path, queries, k, nprobe, refine).select("query_id", "id").join(exact, ["query_id", "id"], "left_semi").count()
        if total == 0 or hits >= recall * total or nprobe >= cells:
            return min(nprobe, cells), hits / total if total else 1.0
        nprobe *= 2
