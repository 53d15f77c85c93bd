"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents and the benchmark items are TF-IDF vectors over the benchmark's words. A
randomised SVD, whose products with the corpus are computed by tasks and summed in a tree, gives a
latent space in which passages near an item are candidates; these bring the paraphrases. For copies there is an
exact net besides: every stride with one of those words of an item of which no copy can lack all
(``telling_words``). The longest common subsequence of words within a stretch little longer than the item, and for
paraphrases the item's answer, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import shingles, workers
from starloom.llm.names import unused
from starloom.plans.durable import durable

#: Words of a passage are two strides; passages begin every stride.
STRIDE = 16
#: Most words of benchmark text that one pass over the corpus looks for; larger benchmarks take several.
BLOCK_WORDS = 100_000
#: Items of fewer words must stand word by word; of fewer than ``LONE``, they must be all that a document says.
SHORT, LONE = 8, 5
#: Partial sums over the corpus, at most, where there are fewer than half as many cores.
SUM_TASKS = 512


class Items:
    """A block of benchmark items as word hashes, with their vocabulary."""

    def __init__(self, ids: list, texts: list[str], answers: list[str | None]):
        def hashed(values: list[str]) -> list[np.ndarray]:
            data, offsets = shingles.text_bytes(pa.array(values, pa.large_string()))
            data = shingles.folded(data[offsets[0] : offsets[-1]])
            h, owner = shingles.word_hashes(data, offsets[:-1] - offsets[0], shingles.letters(data))
            return [h[owner == i] for i in range(len(values))]

        words = hashed(texts)
        told = hashed([a or "" for a in answers])
        keep = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words, self.told = [ids[i] for i in keep], [words[i] for i in keep], [told[i] for i in keep]
        self.vocabulary = np.unique(np.concatenate(self.words)) if keep else np.empty(0, np.uint64)

    def rows(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF rows, sparse: where each item's entries begin, their words, their values."""
        terms, values = [], []
        for w in self.words:
            at, n = np.unique(np.searchsorted(self.vocabulary, w), return_counts=True)
            value = n * weight[at]
            terms.append(at)
            values.append(value / max(np.linalg.norm(value), 1e-12))
        return np.cumsum([0, *map(len, terms[:-1])]), np.concatenate(terms), np.concatenate(values)


def _times(rows: tuple, dense: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    starts, terms, values = rows
    return np.add.reduceat(dense[terms] * values[:, None], starts, axis=0)


def _add_transposed(rows: tuple, y: np.ndarray, total: np.ndarray) -> None:
    """Add the transpose of sparse rows times ``y`` to ``total``."""
    starts, terms, values = rows
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
    order = np.argsort(terms, kind="stable")
    ends = np.flatnonzero(np.diff(terms[order], prepend=-1))
    total[terms[order][ends]] += np.add.reduceat(y[owner[order]] * values[order][:, None], ends, axis=0)


def _passage_words(texts: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple]:
    """Per slice of texts: (first text, word hashes, owner, place in its text, vocabulary index or -1)."""
    data, offsets = shingles.text_bytes(texts)
    for lo, hi in shingles.slices(offsets):
        part = shingles.folded(data[offsets[lo] : offsets[hi]])
        h, owner = shingles.word_hashes(part, offsets[lo:hi] - offsets[lo], shingles.letters(part))
        if not len(h):
            continue
        counts = np.bincount(owner, minlength=hi - lo)
        place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        yield lo, h, owner, place, np.where(vocabulary[at] == h, at, -1)


def _strides(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's stride, and the first word of every stride."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] % STRIDE == 0)
    return np.cumsum(new) - 1, np.flatnonzero(new)


def tree_sum(parts: DataFrame, length: int) -> np.ndarray:
    """Sum of equally long vectors, one row (blob of doubles) per task: summed by tasks in levels of 32 inputs, then handed over."""

    def add(batches):
        total = np.zeros(length)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(blob.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["blob"])

    parts = durable(parts, "partial-sums")
    n = parts.count()
    while n > 32:
        n = math.ceil(n / 32)
        parts = durable(parts.repartition(n).mapInArrow(add, "blob binary"), "partial-sums")
    rows = parts.coalesce(1).mapInArrow(add, "blob binary").collect()
    return sum((np.frombuffer(r.blob, np.float64) for r in rows), np.zeros(length))


def _few_tasks(docs: DataFrame) -> DataFrame:
    """The same rows in tasks that are long where there are many: each task leaves one partial sum, however many splits the files have."""
    return docs.coalesce(max(SUM_TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism))


def passage_frequencies(docs: DataFrame, vocabulary) -> np.ndarray:
    """In how many passages each vocabulary word occurs; the last entry is the number of passages."""
    size = len(vocabulary.value)

    @workers.released
    def count(batches):
        v, total = vocabulary.value, np.zeros(size + 1)
        for batch in batches:
            for _, _, owner, place, at in _passage_words(batch.column(1), v):
                stride, firsts = _strides(owner, place)
                known = at >= 0
                pairs = np.unique(stride[known] * size + at[known])
                total[:size] += np.bincount(pairs % size, minlength=size)
                total[size] += len(firsts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["blob"])

    return tree_sum(_few_tasks(docs).mapInArrow(count, "blob binary"), size + 1)


def latent_basis(docs: DataFrame, vocabulary, weight: np.ndarray, items: tuple, rank: int, seed: int = 7) -> np.ndarray:
    """(vocabulary, rank) basis of the corpus by a randomised SVD with one pass over all passages.

    With A the TF-IDF matrix of all passages and test vectors O, tasks add up A'(A O); the Nystrom form
    Z (O'Z)^-1 Z' of A'A has its leading eigenvectors in Z (Halko, Martinsson, Tropp 2011). The items
    are passages too.
    """
    size = len(weight)
    width = min(rank + 12, size)
    test = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((test * weight[:, None].astype(np.float32), weight > 0))

    @workers.released
    def multiply(batches):
        v, (ot, used) = vocabulary.value, shared.value
        z = np.zeros((size, width))
        for batch in batches:
            for _, _, owner, place, at in _passage_words(batch.column(1), v):
                stride, _ = _strides(owner, place)
                known = (at >= 0) & used[at]
                stride, at = stride[known], at[known]
                if not len(at):
                    continue
                starts = np.flatnonzero(np.diff(stride, prepend=-1))
                y = np.add.reduceat(ot[at], starts, axis=0)  # A O, a row a passage
                row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
                order = np.argsort(at, kind="stable")
                ends = np.flatnonzero(np.diff(at[order], prepend=-1))
                z[at[order][ends]] += np.add.reduceat(y[row[order]], ends, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.large_binary())], ["blob"])

    z = tree_sum(_few_tasks(docs).mapInArrow(multiply, "blob binary"), size * width).reshape(size, width) * weight[:, None]
    _add_transposed(items, _times(items, test), z)
    q, _ = np.linalg.qr(z)  # O'Z is the quadratic form of A'A on the test vectors
    core = test.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-10
    half = z @ (vectors[:, good] / np.sqrt(values[good]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return (u if u.shape[1] else q)[:, :rank]


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of its words' places) and a list of words."""
    full = row = (1 << length) - 1
    for w in words:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _reach(masks: dict[int, int], length: int, words: list[int], target: int) -> int | None:
    """Place of the word with which ``words`` first hold ``target`` of an item's words in order."""
    full = row = (1 << length) - 1
    for i, w in enumerate(words):
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
            if length - row.bit_count() >= target:
                return i
    return None


def _within(masks: dict[int, int], length: int, words: list[int], target: int, span: int) -> bool:
    """Whether a stretch of at most ``span`` words holds ``target`` of an item's words in order.

    Goes through the stretches that hold so many and no shorter stretch of the same end does.
    """
    mirror = {w: int(f"{m:0{length}b}"[::-1], 2) for w, m in masks.items()}
    start = 0
    while (ahead := _reach(masks, length, words[start:], target)) is not None:
        end = start + ahead
        back = _reach(mirror, length, words[start : end + 1][::-1], target)
        if back < span:
            return True
        start = end - back + 1
    return False


def spanned_subsequence(masks: dict[int, int], length: int, words: list[int], least: int, span: int) -> int:
    """The most of an item's words that a stretch of at most ``span`` words holds in order; 0 if under ``least``."""
    top = common_subsequence(masks, length, words)
    if top < least:
        return 0
    if _within(masks, length, words, top, span):
        return top
    if not _within(masks, length, words, least, span):
        return 0
    low = least
    while top - low > 1:
        middle = (low + top) // 2
        if _within(masks, length, words, middle, span):
            low = middle
        else:
            top = middle
    return low


def _rarest(places: dict[int, int], df: np.ndarray, missing: float) -> list[int]:
    """The rarest vocabulary words of ``places`` (times that each stands there), so many that more than a share ``missing`` of all places are theirs."""
    need = math.floor(missing * sum(places.values()) + 1e-6) + 1
    out, held = [], 0
    for t in sorted(places, key=lambda t: (df[t], t)):
        if held >= need:
            break
        out.append(t)
        held += places[t]
    return out


def telling_words(items: Items, df: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by vocabulary word, items): the items of which a word tells.

    What has ``sure`` of an item's words lacks 1 - ``sure`` of its places at most, so it has one of any words
    with more places than that; the rarest are taken. A short item has all of its words.
    """
    told: list[list[int]] = [[] for _ in df]
    for k, w in enumerate(items.words):
        at, n = np.unique(np.searchsorted(items.vocabulary, w), return_counts=True)
        for t in _rarest(dict(zip(at.tolist(), n.tolist(), strict=True)), df, 1 - sure if len(w) >= SHORT else 0.0):
            told[t].append(k)
    return np.concatenate([[0], np.cumsum([len(x) for x in told])]), np.array([k for x in told for k in x], np.int64)


def _search(docs: DataFrame, items: Items, vocabulary, df: np.ndarray, weight: np.ndarray, basis: np.ndarray, cosine: float, overlap: float, sure: float, likely: float, answer: float, span: float) -> DataFrame:
    spark = docs.sparkSession
    # A passage's cosine with an item, both as long as they are outside the latent space, over the item's own.
    targets = _times(items.rows(weight), basis)
    targets /= np.maximum((targets * targets).sum(axis=1, keepdims=True), 1e-6)
    squares = weight**2
    terms = [np.unique(np.searchsorted(items.vocabulary, w)) for w in items.words]
    pairs = np.concatenate([i * len(weight) + t for i, t in enumerate(terms)])  # ascending
    # What a passage of two strides can hold of an item, in squared weights, and the share of it that is asked for.
    asked = np.array([squares[t].sum() * min(1.0, 1.5 * STRIDE / len(w)) for t, w in zip(terms, items.words, strict=True)]) * overlap
    masks, answers = [], []
    for w, told in zip(items.words, items.told, strict=True):
        mask: dict[int, int] = {}
        for i, x in enumerate(w.tolist()):
            mask[x] = mask.get(x, 0) | 1 << i
        masks.append(mask)
        rare = sorted(mask, key=lambda x: -weight[np.searchsorted(items.vocabulary, np.uint64(x))])
        answers.append(set(told.tolist()) or set(rare[:5]))
    lengths = [len(w) for w in items.words]
    shared = spark.sparkContext.broadcast(((basis * weight[:, None]).astype(np.float32), targets.T.astype(np.float32).copy(), masks, lengths, answers, items.ids, pairs, asked, *telling_words(items, df, sure)))
    used = weight > 0
    unknown = float(np.median(weight[used])) ** 2  # what a word that no item has adds to a passage's squared length

    @workers.released
    def find(batches):
        v = vocabulary.value
        project, wanted, masks, lengths, answers, names, pairs, asked, tells, told_of = shared.value
        step = max(1, 2_000_000 // max(1, wanted.shape[1]))
        for batch in batches:
            ids = batch.column(0)
            best: dict[tuple, tuple] = {}

            def decide(lo: int, h: np.ndarray, owner: np.ndarray, start: int, back: int, k: int, near: float, best=best) -> None:
                n, doc = lengths[k], int(owner[start])
                if n < LONE and np.searchsorted(owner, doc, "right") - np.searchsorted(owner, doc) != n:
                    return
                begin, end = max(start - n, start - back), start + 2 * STRIDE + n
                region = h[begin:end][owner[begin:end] == doc].tolist()
                common = spanned_subsequence(masks[k], n, region, *((n, n) if n < SHORT else (math.ceil(likely * n), math.floor(span * n))))
                if not common:
                    return
                seen = set(region)
                told = sum(x in seen for x in answers[k]) / len(answers[k])
                if common >= sure * n or told >= answer:
                    key, value = (lo + doc, k), (common, told, near)
                    best[key] = max(best.get(key, value), value)

            for lo, h, owner, place, at in _passage_words(batch.column(1), v):
                stride, firsts = _strides(owner, place)
                known = (at >= 0) & used[at]
                s, a = stride[known], at[known]
                sums = np.zeros((len(firsts), project.shape[1]), np.float32)
                if len(a):
                    starts = np.flatnonzero(np.diff(s, prepend=-1))
                    sums[s[starts]] = np.add.reduceat(project[a], starts, axis=0)
                square = np.add.reduceat(np.where(at >= 0, squares[at], unknown), firsts)
                passage, size = sums.copy(), square.copy()
                together = owner[firsts][1:] == owner[firsts][:-1]
                passage[:-1][together] += sums[1:][together]
                size[:-1][together] += square[1:][together]
                size = np.sqrt(size)  # of the passage itself, not of what the latent space keeps of it
                rows = np.flatnonzero(np.abs(passage).max(axis=1) > 1e-6)
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    near = (passage[part] @ wanted) / size[part][:, None]
                    found, which = np.nonzero(near >= cosine)
                    starts = firsts[part[found]]
                    # The same in full: the weight of the item's words that the passage holds.
                    spot = starts[:, None] + np.arange(2 * STRIDE)
                    inside = spot < len(h)
                    spot = np.minimum(spot, len(h) - 1)
                    inside &= (owner[spot] == owner[starts][:, None]) & (at[spot] >= 0)
                    key = which[:, None] * len(squares) + np.maximum(at[spot], 0)
                    held = inside & (pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key)
                    enough = (held * squares[np.maximum(at[spot], 0)]).sum(axis=1) >= asked[which]
                    for r, k in zip(found[enough].tolist(), which[enough].tolist(), strict=True):
                        start = int(firsts[part[r]])
                        decide(lo, h, owner, start, int(place[start]), k, float(near[r, k]))
                # Strides with a telling word, near or not; a copy that is found whole is not looked at again.
                spot = np.flatnonzero(at >= 0)
                many = tells[at[spot] + 1] - tells[at[spot]]
                spot, many = spot[many > 0], many[many > 0]
                if not len(spot):
                    continue
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                which = told_of[np.repeat(tells[at[spot]], many) + within]
                for x in np.unique(np.repeat(stride[spot], many) * len(lengths) + which).tolist():
                    p, k = divmod(x, len(lengths))
                    start = int(firsts[p])
                    if best.get((lo + int(owner[start]), k), (0, 0.0))[:2] != (lengths[k], 1.0):
                        decide(lo, h, owner, start, int(place[start]), k, float(passage[p] @ wanted[:, k] / max(size[p], 1e-12)))
            if best:
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": ids[d].as_py(), "item_id": names[k], "cosine": min(1.0, c), "lcs_words": n, "lcs_share": n / lengths[k], "answer_share": t} for (d, k), (n, t, c) in best.items()], schema=out
                )

    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_words", pa.int64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
    return docs.mapInArrow(find, "doc_id long, item_id long, cosine double, lcs_words long, lcs_share double, answer_share double")


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Benchmark items in blocks of bounded size, each held by the driver on its own."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer"))
    total = rows.agg(F.sum(words)).first()[0] or 0
    blocks = math.ceil(total / BLOCK_WORDS)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in part], [r.text for r in part], [r.answer for r in part])
        if items.ids:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 128, most: float = 0.001, cosine: float = 0.4, overlap: float = 0.3, sure: float = 0.8, likely: float = 0.6, answer: float = 0.8, span: float = 1.5) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_words, lcs_share, answer_share): items found in documents.

    A passage at ``cosine`` or more of an item in latent space is held against it in full: it must hold
    ``overlap`` of the item's squared weight, or of the part that fits a passage. Paraphrases come this way alone.
    A passage whose first stride holds one of an item's telling words needs neither, so copies of any length, in any
    surroundings and any number, are looked at. Then word by word: the item
    is there if, of the passage's surroundings, a stretch of at most ``span`` times its length has a common subsequence
    of ``sure`` of its words with it, or of ``likely`` of them while the surroundings have ``answer`` of its answer's
    words (the item's answer column if there is one, else its five rarest words). An item of fewer than ``SHORT`` words
    is there where all its words follow one another; one of fewer than ``LONE``, which any text may say, only
    where a document has no other words. Words in more than ``most`` of all passages weigh nothing, but for the
    eight rarest of each item. Every document is read whole, and all passages count.

    Words are runs of letters and digits, case aside (Latin, Greek, Cyrillic); typographic marks are no letters.

    Edge cases: null and empty texts have no passage; very long texts are gone through in slices that end with a text; a null
    doc_id is kept as null; an empty benchmark, or one without words, finds
    nothing; repeated documents each have their rows; equal items are each found; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for items in item_blocks(benchmark):
        vocabulary = spark.sparkContext.broadcast(items.vocabulary)
        with workers.small_batches(spark):
            *df, n = passage_frequencies(docs, vocabulary).tolist()
        df = np.maximum(np.array(df), 1.0)
        weight = np.log((n + 1.0) / df)
        rare = np.zeros(len(df), bool)
        for w in items.words:
            at = np.unique(np.searchsorted(items.vocabulary, w))
            rare[at[np.argsort(df[at], kind="stable")[:8]]] = True
        weight = np.where((df <= max(most * n, 5)) | rare, np.maximum(weight, 1e-3), 0.0)
        with workers.small_batches(spark):
            basis = latent_basis(docs, vocabulary, weight, items.rows(weight), rank)
        hits = _search(docs, items, vocabulary, df, weight, basis, cosine, overlap, sure, likely, answer, span)
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_words long, lcs_share double, answer_share double")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found, with the columns that they came with; rows of one doc_id share their fate."""
    (hit,) = unused(docs.columns, "_hit")
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(hit)).distinct()
    with workers.small_batches(docs.sparkSession):
        hits = durable(found, "contaminated")
    return docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(hit)), "left_anti")
