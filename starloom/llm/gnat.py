"""Hard negatives by a multiway hyperplane tree whose split points know how far each sibling subtree reaches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.sampling import first_by_hash
from starloom.llm.workers import released
from starloom.plans.durable import durable

#: Rows of a block of data, and of anchors, that are solved against each other.
DATA_BLOCK, ANCHOR_BLOCK = 4096, 256
_NONE = -(1 << 62)
_DATA = "leaf long, part long, n long, ids binary, rows binary, labels binary, vectors binary"
_ASKED = "leaf long, parts long, n_a long, a_rows binary, a_labels binary, a_low binary, a_high binary, a_least binary, a_vectors binary"


def prepared(embeddings: DataFrame, scale: float = 256.0, relabel: int | None = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component.

    Rows with a null vec_id, label or vector, an empty vector, or null or non-finite components are left out. Where
    ``relabel`` divides vec_id, the label moves on by one, modulo ``labels``.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Tree:
    """Split points of a bounded sample; a row falls to the nearest split point, level by level, down to a leaf.

    Inner products become distances on a sphere: a row x gets one more coordinate, sqrt(M^2 - |x|^2), with M the
    greatest length, an anchor a gets 0; then |a - x|^2 = |a|^2 + M^2 - 2 a.x, so a window of scores is an annulus of
    distances around the anchor. The widest of ``fanout`` far-apart sample points of a node split it.
    """

    def __init__(self, sample: np.ndarray, top2: float, fanout: int, depth: int):
        self.top2, self.fanout = top2, fanout
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # split points; children: nodes, or ~leaf
        self.leaves = 0
        x = self.lifted(sample)
        self.root = self._grow(x, depth)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.top2 - (x * x).sum(1)))])

    def _grow(self, x: np.ndarray, depth: int) -> int:
        points = x[:1]
        while depth and len(points) < min(self.fanout, len(x)):
            away = _distances(x, points).min(1)
            if away.max() <= 1e-9:
                break
            points = np.vstack([points, x[away.argmax()]])
        if len(points) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append((points, []))
        near = _distances(x, points).argmin(1)
        self.nodes[at][1].extend(self._grow(x[near == j], depth - 1) for j in range(len(points)))
        return at

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """The leaf of each row, and (node, child, distances to all split points of the node) of the rows that pass through."""
        x = self.lifted(x)
        leaf, passed, todo = np.zeros(len(x), np.int64), [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = ~node
                continue
            points, children = self.nodes[node]
            d = _distances(x[rows], points)
            near = d.argmin(1)
            for j, child in enumerate(children):
                mine = near == j
                if mine.any():
                    passed.append((node, j, d[mine]))
                    todo.append((child, rows[mine]))
        return leaf, passed

    def wanted(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: dict) -> list[tuple[int, np.ndarray]]:
        """(leaf, anchors) where a leaf may hold a row whose score with the anchor lies in low..high.

        A sibling subtree whose distances from a split point lie in [lo, hi] is within [max(D - hi, lo - D), D + hi] of an anchor
        at distance D from that split point; where this misses the anchor's annulus for one split point, it is out.
        """
        a2 = (a * a).sum(1)
        near = np.sqrt(np.maximum(0.0, a2 + self.top2 - 2 * high)) - 1e-6
        far = np.sqrt(np.maximum(0.0, a2 + self.top2 - 2 * low)) + 1e-6
        point = np.column_stack([a, np.zeros(len(a))])
        out, todo = [], [(self.root, np.flatnonzero(low <= high))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((~node, rows))
                continue
            points, children = self.nodes[node]
            d = _distances(point[rows], points)
            for j, child in enumerate(children):
                if (node, j) in ranges:  # else no row passed there
                    lo, hi = ranges[node, j]
                    least = np.maximum(d - hi, lo - d).max(1)
                    most = (d + hi).min(1)
                    todo.append((child, rows[(least <= far[rows]) & (most >= near[rows])]))
        return out


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ points.T) + (points * points).sum(1)
    return np.sqrt(np.maximum(0.0, d2))


def hard_negatives(vectors: DataFrame, is_anchor=None, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, fanout: int = 12, depth: int = 2, sample: int = 2048) -> DataFrame:
    """Per anchor and positive the first negatives in the window: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is (vec_id, label, v) with integral components; ``is_anchor`` is a condition on its rows. Positives are
    an anchor's ``positives`` best other rows of its label; a negative has another label and a score of ``least`` to
    ``most`` percent of the positive's. Higher scores come first, ties by smaller vec_id.

    1. The tree's split points come from a bounded sample, the first vec_ids by hash (``sample``).
    2. Every row descends to its leaf; per split point and sibling the least and greatest distance are kept, at most
       fanout * fanout for a node. Leaves are packed in blocks of ``DATA_BLOCK`` rows, so that a leaf of any size is spread.
    3. Anchors go, in blocks, only to leaves whose ranges meet the annulus of their window. For positives it is what
       can beat the k-th best of their label in the sample; for negatives the windows of their positives, from the k-th
       best of the sample in the window on.
    4. Each (anchor block, data block) is solved exactly on its own; windows over anchors keep the first.

    Scores are sums of products of integers in doubles, exact below 2**53. Rows that repeat a vec_id are rows of their own, as
    anchors too. Vectors of another dimension than the anchor's are no partners. A positive score of 0 or less has the window that
    the inequality leaves (none below 0). Without anchors, partners or rows there is no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    if is_anchor is None:
        is_anchor = F.col("vec_id") % 100 == 0
    data = durable(vectors.select("vec_id", "label", F.monotonically_increasing_id().alias("row"), "v", is_anchor.alias("anchor")), "vectors")
    chosen = F.broadcast(first_by_hash(data, "vec_id", sample))
    first = data.join(chosen, "vec_id").groupBy("vec_id").agg(F.min_by(F.struct("row", "label", "v"), "row").alias("x")).orderBy(F.xxhash64("vec_id"), "vec_id").select("x.*").collect()
    # One row for each dimension that anchors have.
    dims = sorted(r[0] for r in data.where("anchor").groupBy(F.size("v")).count().collect())
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for d in dims:
        found = _one_dimension(data.where(F.size("v") == d), [r for r in first if len(r.v) == d], d, positives, negatives, least, most, fanout, depth)
        out = out.unionByName(found)
    return out


def _one_dimension(data: DataFrame, first: list, dim: int, positives: int, negatives: int, least: int, most: int, fanout: int, depth: int) -> DataFrame:
    spark = data.sparkSession
    first = first or data.limit(1).select("row", "label", "v").collect()
    sample = np.array([r.v for r in first], np.float64).reshape(-1, dim)
    s_rows, s_labels = np.array([r.row for r in first], np.int64), np.array([r.label for r in first], np.int64)
    top2 = data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    tree = Tree(sample, float(top2), fanout, depth)

    @released
    def reach(batches):
        """Leaf sizes and distance ranges, as rows of one shape: (node, child, split point, least, greatest, rows)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, passed = tree.descend(_matrix(batch.column(0), dim))
            rows = [(-1, int(j), 0, 0.0, 0.0, int(n)) for j, n in zip(*np.unique(leaf, return_counts=True), strict=True)]
            rows += [(node, j, i, float(d[:, i].min()), float(d[:, i].max()), 0) for node, j, d in passed for i in range(d.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["node", "child", "point", "lo", "hi", "n"])

    shape = "node long, child long, point long, lo double, hi double, n long"
    summary = data.select("v").mapInArrow(reach, shape).groupBy("node", "child", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).orderBy("point").collect()
    size = {r.child: r.n for r in summary if r.node < 0}
    parts = {j: -(-n // DATA_BLOCK) for j, n in size.items()}
    between: dict[tuple[int, int], tuple[list, list]] = {}
    for r in summary:
        if r.node >= 0:
            lo, hi = between.setdefault((r.node, r.child), ([], []))
            lo.append(r.lo - 1e-6), hi.append(r.hi + 1e-6)
    ranges = {k: (np.array(lo), np.array(hi)) for k, (lo, hi) in between.items()}

    @released
    def place(batches):
        for batch in batches:
            leaf, _ = tree.descend(_matrix(batch.column(3), dim)) if batch.num_rows else (np.empty(0, np.int64), None)
            split = np.array([parts[int(j)] for j in leaf], np.int64)
            part = batch.column(2).to_numpy() % np.maximum(1, split)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part), *batch.columns], ["leaf", "part", "vec_id", "label", "row", "v"])

    @released
    def pack(batches):
        """Rows sorted by leaf and part to blocks; a block ends with its part, or the batch."""
        for batch in batches:
            leaf, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for a in range(lo, hi, DATA_BLOCK):
                    b = batch.slice(a, min(DATA_BLOCK, hi - a))
                    x = _matrix(b.column(5), dim)
                    kind = np.int16 if np.abs(x).max() < 32768 else np.float64
                    raw = [b.column(i).to_numpy().astype("<i8").tobytes() for i in (2, 4, 3)]
                    yield pa.RecordBatch.from_pylist([{"leaf": int(leaf[a]), "part": int(part[a]), "n": b.num_rows, "ids": raw[0], "rows": raw[1], "labels": raw[2], "vectors": x.astype(kind).tobytes()}])

    spread = data.select("vec_id", "label", "row", "v").mapInArrow(place, "leaf long, part long, vec_id long, label long, row long, v array<double>").repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    blocks = durable(spread.mapInArrow(pack, _DATA), "leaves")

    def ask(low_of, width: int):
        """A task's function from anchor rows to blocks of anchors by leaf; ``low_of`` gives windows and the least score that counts."""

        @released
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ANCHOR_BLOCK):
                    b = batch.slice(at, ANCHOR_BLOCK)
                    a = _matrix(b.column(2), dim)
                    rows, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
                    low, high, floor = low_of(b, a, rows, labels)  # (anchors, width)
                    reach_low, reach_high = np.where(low <= high, floor, np.inf).min(1), np.where(low <= high, high, -np.inf).max(1)
                    kind = np.int16 if np.abs(a).max() < 32768 else np.float64
                    for leaf, mine in tree.wanted(a, reach_low.astype(float), reach_high.astype(float), ranges):
                        raw = [c[mine].astype("<i8").tobytes() for c in (rows, labels, low, high, floor)]
                        yield pa.RecordBatch.from_pylist([dict(zip(("leaf", "parts", "n_a", "a_rows", "a_labels", "a_low", "a_high", "a_least", "a_vectors"), (leaf, parts.get(leaf, 0), len(mine), *raw, a[mine].astype(kind).tobytes()), strict=True))])

        return run

    def solve(same: bool, keep: int, width: int):
        """The best ``keep`` rows of a block in each window of each anchor."""

        @released
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    long = lambda c: np.frombuffer(r[c], "<i8")  # noqa: E731, B023
                    grid = lambda c, n: np.frombuffer(r[c], np.int16 if len(r[c]) == 2 * n * dim else np.float64).reshape(n, dim).astype(np.float64)  # noqa: E731, B023
                    order = np.lexsort((long("rows"), long("ids")))  # ties keep the smaller id
                    ids, rows, labels, x = long("ids")[order], long("rows")[order], long("labels")[order], grid("vectors", r["n"])[order]
                    a, a_rows, a_labels = grid("a_vectors", r["n_a"]), long("a_rows"), long("a_labels")
                    high, floor = (long(c).reshape(-1, width) for c in ("a_high", "a_least"))
                    s = a @ x.T
                    fits = (a_labels[:, None] == labels) == same
                    fits &= a_rows[:, None] != rows
                    found: list[tuple] = []
                    for w in range(width):
                        inside = fits & (s >= floor[:, w, None]) & (s <= high[:, w, None])
                        for i in np.flatnonzero(inside.any(1)):
                            at = np.flatnonzero(inside[i])
                            if len(at) > keep:
                                kth = np.partition(s[i, at], -keep)[-keep]
                                at = at[s[i, at] >= kth]
                            at = at[np.argsort(-s[i, at], kind="stable")][:keep]
                            found.append((np.full(len(at), a_rows[i]), np.full(len(at), w), ids[at], rows[at], s[i, at]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(pa.int64()) for c in zip(*found, strict=True)], ["anchor_row", "slot", "vec_id", "row", "score"])

        return run

    def search(anchors: DataFrame, low_of, same: bool, keep: int, width: int) -> DataFrame:
        asked = anchors.mapInArrow(ask(low_of, width), _ASKED).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "a_low")
        hits = asked.join(blocks, ["leaf", "part"]).select("n_a", "a_rows", "a_labels", "a_high", "a_least", "a_vectors", "n", "ids", "rows", "labels", "vectors").mapInArrow(solve(same, keep, width), "anchor_row long, slot long, vec_id long, row long, score long")
        best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)

    def kth(s: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each row, with unwanted ones at -inf; the least long where there are fewer."""
        best = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf)
        return np.where(np.isfinite(best), np.maximum(best, _NONE), _NONE).astype(np.int64)

    def sampled(a, rows, labels, same):
        s = a @ sample.T
        s[((labels[:, None] == s_labels) != same) | (rows[:, None] == s_rows)] = -np.inf
        return s

    def any_score(b, a, rows, labels):
        low = np.full((len(rows), 1), _NONE, np.int64)
        return low, np.full((len(rows), 1), -_NONE, np.int64), kth(sampled(a, rows, labels, True), positives)[:, None]

    def windows(b, a, rows, labels):
        score = np.zeros((len(rows), positives), np.int64)
        known = np.zeros(score.shape, bool)
        for i, found in enumerate(b.column(3).to_pylist()):
            score[i, : len(found)], known[i, : len(found)] = found, True
        low, high = -((-least * score) // 100), (most * score) // 100
        high[~known] = low[~known] - 1
        s = sampled(a, rows, labels, False)
        floor = np.column_stack([np.maximum(low[:, w], kth(np.where((s >= low[:, w, None]) & (s <= high[:, w, None]), s, -np.inf), negatives)) for w in range(positives)])
        return low, high, floor

    anchors = data.where("anchor")
    good = durable(search(anchors.select("row", "label", "v"), any_score, True, positives, 1).select("anchor_row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = good.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    bad = search(anchors.join(listed, "row").select("row", "label", "v", "scores"), windows, False, negatives, positives)
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    pairs = bad.select("anchor_row", (F.col("slot") + 1).cast("int").alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(good, ["anchor_row", "place"]).join(named, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT * FROM n WHERE rank <= 10
"""
