"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017) over words and word beginnings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import workers
from starloom.llm.names import unused
from starloom.llm.sampling import first_by_hash
from starloom.plans.durable import durable

_WORD = re.compile(r"\w+")
#: Words remembered by a scoring worker before it starts afresh.
MEMO = 150_000


def features(word: str) -> list[str]:
    """A lower-case word, and its beginnings of 4 to 6 characters, which inflected forms share."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def held_out(doc_id="doc_id"):
    """crc32 of doc_id as text is 1 modulo 3."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(text, positive): the bounded fitting sample, never from held-out rows.

    Confirmed toxic documents, at most ``positives`` of them, and at most ``unlabelled`` documents drawn
    without a look at their labels; both are the first by hash of doc_id, one text for each doc_id.
    """
    seen = docs.where(~held_out()).select("doc_id", "text")
    toxic = labels.where((F.col("toxic") == 1) & ~held_out())

    def first(keys: DataFrame, n: int) -> DataFrame:
        chosen = F.broadcast(first_by_hash(keys, "doc_id", n))  # at most n ids
        return seen.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")

    return durable(first(toxic, positives).withColumn("positive", F.lit(True)).union(first(seen, unlabelled).withColumn("positive", F.lit(False))), "toxicity-sample")


def select_features(sample: DataFrame, size: int, least: int) -> list[str]:
    """The ``size`` features most over-represented in positives, of those in ``least`` positives or more."""

    @workers.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {True: Counter(), False: Counter()}
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[positive].update({f for w in distinct_words(text) for f in features(w)})
            names = list(found[True] | found[False])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[x][f] for f in names], pa.int64()) for x in (True, False))], ["feature", "p", "u"])

    total = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = total.get(True, 0), total.get(False, 0)
    counts = sample.select("text", "positive").mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    lift = F.log((F.col("p") + 0.5) / (n_p + 1.0)) - F.log((F.col("u") + 0.5) / (n_u + 1.0))
    best = counts.where((F.col("p") >= least) & (lift > 0.5)).withColumn("z", lift * F.sqrt("p")).orderBy(F.desc("z"), "feature").limit(size)
    return sorted(r.feature for r in best.collect())


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression with the non-negative PU risk; returns ``size`` weights and the intercept.

    R = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]). Where the second term is
    negative, the step goes against it instead, so that the model can't gain by over-fitting positives.
    """
    lengths = np.array([len(r) for r in rows])
    owner, index = np.repeat(np.arange(len(rows)), lengths), np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    p, u = positive / max(positive.sum(), 1), ~positive / max((~positive).sum(), 1)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(owner, w[index], len(rows)) + w[-1], -30, 30)
        s = 1 / (1 + np.exp(-z))  # the slope of loss(-) is s, of loss(+) s - 1
        minus = np.logaddexp(0, z)
        negative_risk = u @ minus - prior * (p @ minus)
        slope = (u - prior * p) * s
        slope = prior * p * (s - 1) + slope if negative_risk >= 0 else -slope
        g = np.append(np.bincount(index, slope[owner], size), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, size: int = 8192, least: int = 4) -> tuple[dict[str, float], float]:
    """Weights by feature, and the intercept.

    Fitted on a bounded sample: ``positives`` labelled toxic, and ``unlabelled`` of the corpus, which a positive-unlabelled
    risk needs as the mixture that it corrects; the class prior is the
    share of toxic labels among all labels outside the held-out third. Without any toxic label the
    weights are empty and every score is the prior.
    """
    seen = labels.where(~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(seen if seen is not None else 0.01, 1e-3), 0.5)
    sample = training_sample(docs, labels, positives, unlabelled)
    names = select_features(sample, size, least)
    at = {f: i for i, f in enumerate(names)}

    @workers.released
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sorted(at[f] for w in distinct_words(t) for f in features(w) if f in at) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.int32()))], ["positive", "x"])

    rows = sample.select("text", "positive").mapInArrow(sparse, "positive boolean, x array<int>").collect() if names else []  # of the bounded sample
    if not rows:
        return {}, float(np.log(prior / (1 - prior)))
    w = fit_nnpu([np.asarray(r.x, np.int64) for r in rows], np.array([r.positive for r in rows]), len(names), prior)
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def scorer(weights: dict[str, float], intercept: float):
    """A Column function: the probability that a whole text is toxic."""

    @workers.released
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, get, known = _WORD.findall, weights.get, {}
        for texts in parts:
            z = np.full(len(texts), intercept)
            if len(known) > MEMO:
                known.clear()
            for lo in range(0, len(texts), 256):
                for i, text in enumerate(texts.slice(lo, 256).to_pylist(), lo):
                    if text:
                        total = 0.0
                        for word in set(find(text.lower())):
                            if (g := known.get(word)) is None:
                                g = known[word] = sum(get(f, 0.0) for f in features(word))
                            total += g
                        z[i] += total
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return scored(parts)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Add ``score`` (0 to 1) to every document; only its text is looked at.

    Edge cases: null and empty texts score the intercept alone; rows with equal texts have equal scores; an
    empty documents or labels table gives an untrained score, the class prior; a column named score is replaced.
    """
    weights, intercept = train(docs, labels, **options)
    return docs.drop("score").withColumn("score", scorer(weights, intercept)("text"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents whose score is below ``threshold``, with the columns that they came with, whatever their names.

    Rows that repeat a doc_id, or have none, are judged each by its text; very long texts are scored whole.
    """
    (score,) = unused(docs.columns, "score")
    weights, intercept = train(docs, labels, **options)
    return docs.withColumn(score, scorer(weights, intercept)("text")).where(F.col(score) < threshold).select(*docs.columns)
