"""Exact top-k by inner product: a Voronoi join of query groups with the data blocks that they need."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.sampling import first_by_hash
from starloom.llm.workers import released
from starloom.plans.durable import durable

_BLOCK = "grp long, salt long, n long, ids binary, rows binary, vectors binary"
#: Tasks that the work of a group is dealt to, over all groups, for each shuffle partition.
SPREAD = 2


def quantised(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null, empty or hold null, NaN or infinite components are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _dealt(batch: pa.RecordBatch):
    """The batch's rows by dimension: (dim, ids, rows, matrix)."""
    sizes = np.asarray(pc.list_value_length(batch.column(2)))
    for dim in np.unique(sizes):
        part = batch.filter(pa.array(sizes == dim))
        yield int(dim), part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), int(dim))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)
    cell = d2.argmin(1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def top_k(vectors: DataFrame, k: int = 20, is_query=None, pivots: int = 16, sample: int = 1024, block: int = 8192) -> DataFrame:
    """For each query its ``k`` largest inner products with all other rows: query_id, rank, vec_id, score.

    ``vectors`` is (vec_id, v) with integral components; ``is_query`` is a condition on its rows.

    1. Pivots and a threshold sample, the first vec_ids by hash, go to the driver: bounded by ``sample``.
    2. Queries and data fall to their nearest pivot. A cell is summarised by its count, its radius and, for
       queries, by the least threshold: the k-th best score of a query with the sample is a lower bound
       of its k-th best score with everything.
    3. A group of queries around p with radius R can reach a score t with data x only if
       p.x + R|x| >= t; by cells, if p.c + |p|r + |c|R + Rr >= t. Only such data are copied to the group,
       packed in blocks of at most ``block`` vectors. A group's queries are packed in such blocks too.
    4. Each (query block, data block) is solved in memory on its own and gives at most k rows a query;
       a window keeps the best k. The data blocks of a group are dealt to as many tasks as its share of all
       the work asks for, so a cell with most of the rows is spread over most of the tasks.

    Scores are sums of products of integers in doubles, exact below 2**53. Ties go to the smaller vec_id.
    Vectors of another dimension than the query's are no candidates. Rows that repeat a vec_id are rows of their own: each
    is a candidate of the others, and each query row has its own result under its vec_id. An empty table, or one
    without queries, gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    if is_query is None:
        is_query = F.col("vec_id") % 20 == 0
    vectors = durable(vectors.select("vec_id", F.monotonically_increasing_id().alias("row"), "v"), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    chosen = F.broadcast(first_by_hash(vectors, "vec_id", sample))
    first = vectors.join(chosen, "vec_id").groupBy("vec_id").agg(F.min_by("row", "row").alias("row"), F.min_by("v", "row").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    dims = sorted({len(r.v) for r in first} | {r[0] for r in vectors.where(is_query).groupBy(F.size("v")).count().collect()})
    results = [_one_dimension(vectors.where(F.size("v") == d), [r for r in first if len(r.v) == d], d, k, is_query, pivots, block) for d in dims]
    results = [r for r in results if r is not None]
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _one_dimension(data: DataFrame, first: list, dim: int, k: int, is_query, pivots: int, block: int) -> DataFrame | None:
    spark = data.sparkSession
    if not first:
        first = data.limit(k + 1).collect()
    sample_rows = np.array([r.row for r in first], np.int64)
    sample = np.array([r.v for r in first], np.float64).reshape(-1, dim)
    centres = np.unique(sample[:pivots], axis=0)

    @released
    def summarise(batches):
        for batch in batches:
            for _, _, rows, x in _dealt(batch.select([0, 1, 2])):
                cell, away = _nearest(x, centres)
                query = batch.column(3).to_numpy(zero_copy_only=False)
                low = np.full(len(rows), np.inf)
                if query.any():
                    s = x[query] @ sample.T
                    s[rows[query][:, None] == sample_rows] = -np.inf
                    low[query] = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else -np.inf
                for c in np.unique(cell):
                    at, q = cell == c, (cell == c) & query
                    yield pa.RecordBatch.from_pylist([{"cell": int(c), "n": int(at.sum()), "radius": float(away[at].max()), "n_q": int(q.sum()), "radius_q": float(away[q].max()) if q.any() else 0.0, "low": float(low[q].min()) if q.any() else float("inf")}])

    parts = data.select("vec_id", "row", "v", is_query.alias("q")).mapInArrow(summarise, "cell long, n long, radius double, n_q long, radius_q double, low double")
    cells = {r.cell: r for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("n_q").alias("n_q"), F.max("radius_q").alias("radius_q"), F.min("low").alias("low")).collect()}
    groups = [c for c, r in cells.items() if r.n_q]
    if not groups:
        return None
    norm = np.linalg.norm(centres, axis=1)
    need = {
        j: [i for i in groups if centres[i] @ centres[j] + norm[i] * cells[j].radius + norm[j] * cells[i].radius_q + cells[i].radius_q * cells[j].radius >= cells[i].low - 1e-6]
        for j in cells
    }
    radius = {i: cells[i].radius_q for i in groups}
    low = {i: cells[i].low for i in groups}
    work = {i: cells[i].n_q * sum(cells[j].n for j in cells if i in need[j]) for i in groups}
    tasks = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = {i: max(1, round(tasks * work[i] / max(1, sum(work.values())))) for i in groups}

    def pack(group: int, salt: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> dict:
        kind = np.int16 if np.abs(x).max(initial=0) < 32768 else np.float64
        return {"grp": group, "salt": salt, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "rows": rows.astype("<i8").tobytes(), "vectors": x.astype(kind).tobytes()}

    def unpack(n: int, ids: bytes, rows: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.float64).reshape(n, dim).astype(np.float64)

    @released
    def replicate(batches):
        """Data blocks of the groups that need them."""
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                for _, ids, rows, x in _dealt(batch.slice(lo, block)):
                    cell, _ = _nearest(x, centres)
                    size = np.linalg.norm(x, axis=1)
                    for i in groups:
                        reach = x @ centres[i] + radius[i] * size >= low[i] - 1e-6
                        keep = reach & np.isin(cell, [j for j, g in need.items() if i in g])
                        if keep.any():
                            yield pa.RecordBatch.from_pylist([pack(i, turn % salts[i], ids[keep], rows[keep], x[keep])])
                    turn += 1

    @released
    def place(batches):
        """The group of each query."""
        for batch in batches:
            cell, _ = _nearest(_matrix(batch.column(2), dim), centres)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns[:3]], ["grp", "vec_id", "row", "v"])

    @released
    def gather(batches):
        """Query blocks by group."""
        for batch in batches:
            group = batch.column(0).to_numpy()
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                x = _matrix(part.column(3), dim)
                for i in np.unique(group[lo : lo + block]):
                    at = group[lo : lo + block] == i
                    yield pa.RecordBatch.from_pylist([pack(int(i), 0, part.column(1).to_numpy()[at], part.column(2).to_numpy()[at], x[at])])

    @released
    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_rows, q = unpack(row["n_q"], row["q_ids"], row["q_rows"], row["q_vectors"])
                ids, rows, x = unpack(row["n"], row["ids"], row["rows"], row["vectors"])
                order = np.lexsort((rows, ids))
                ids, rows, x = ids[order], rows[order], x[order]
                for lo in range(0, len(q_ids), 512):
                    s = q[lo : lo + 512] @ x.T
                    s[q_rows[lo : lo + 512, None] == rows] = -np.inf
                    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    found: list[list] = [[], []]
                    for a, scores in enumerate(s):
                        at = np.flatnonzero((scores >= kth[a]) & (scores > -np.inf))
                        at = at[np.argsort(-scores[at], kind="stable")][:k]  # ids ascend, so ties keep the smaller
                        found[0].append(np.full(len(at), lo + a))
                        found[1].append(at)
                    a, at = (np.concatenate(f).astype(np.int64) for f in found)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(q_rows[a]), pa.array(ids[at]), pa.array(rows[at]), pa.array(s[a - lo, at])], ["query_id", "query_row", "vec_id", "row", "score"])

    blocks = data.mapInArrow(replicate, _BLOCK)
    sub = F.pmod(F.col("row"), F.lit(max(1, math.ceil(sum(cells[i].n_q for i in groups) / block))))
    placed = data.where(is_query).mapInArrow(place, "grp long, vec_id long, row long, v array<double>").repartition("grp", sub).sortWithinPartitions("grp")
    spread = F.lit(json.dumps({str(i): n for i, n in salts.items()}))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.from_json(spread, "map<string, long>")[F.col("grp").cast("string")] - 1)).alias("salt")
    asked = placed.mapInArrow(gather, _BLOCK).select("grp", salt, F.col("n").alias("n_q"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    pairs = blocks.join(asked, ["grp", "salt"]).select("n_q", "q_ids", "q_rows", "q_vectors", "n", "ids", "rows", "vectors")
    return pairs.mapInArrow(solve, "query_id long, query_row long, vec_id long, row long, score double")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
