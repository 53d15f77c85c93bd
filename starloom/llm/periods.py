"""Periodic runs of words: an online dynamic program over the few diagonals (lags) that can hold one."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.workers import released

#: A run has at least ``LEAST`` words and ``TIMES`` periods.
LEAST, TIMES = 24, 3
#: Words of documents that are looked at together; a longer document is one such group.
GROUP = 400_000
#: Bytes of results that leave a task at a time.
OUT_BYTES = 8 << 20
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _named(pairs: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers from 0; those that occur once get -1."""
    _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    keep = counts > 1
    number = np.cumsum(keep) - 1
    return np.where(keep, number, -1)[inverse]


def openings(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(last word, lag, words known to match) of every diagonal that is worth following, scale by scale.

    ``words`` are numbered words of documents in a row, ``doc`` the document of each; equal words of two documents
    have different numbers. At scale K, a power of two from 16 on, a position looks at the nearest earlier
    occurrence of the K words that end there, and takes the lag if it is at most K and, beyond 16, above K / 2.

    That is enough. A run of period q has at least max(24 - q, 2q) words equal to those q before, so K of
    them for the scale that q falls to. The nearest earlier occurrence of K >= q words of a run of smallest
    period q lies exactly q before: a nearer one would give the run a smaller period. For the same
    reason no multiple of a smallest period is ever taken. K words are named by the pair of names of their halves,
    so names are exact, and positions whose words occur once are left out of all longer scales.
    """
    at = np.arange(len(words))
    name = words
    k = 1
    while len(at):
        if k >= 16:
            order = np.lexsort((at, name))
            a, n = at[order], name[order]
            same = np.flatnonzero(n[1:] == n[:-1])
            lag = a[same + 1] - a[same]
            near = (lag <= k) & (lag > (0 if k == 16 else k // 2))
            yield a[same + 1][near] + k - 1, lag[near], k
        # The name of 2K words: that of K words here, and of the K words after them.
        second = np.searchsorted(at, at + k)
        there = (second < len(at)) & (at[np.minimum(second, len(at) - 1)] == at + k)
        first, second = np.flatnonzero(there), second[there]
        same_doc = doc[at[first]] == doc[at[first] + k]
        first, second = first[same_doc], second[same_doc]
        named = _named(name[first] * (int(name.max()) + 1) + name[second])
        at, name = at[first][named >= 0], named[named >= 0]
        k *= 2


def runs_online(words: list[int], opens: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of one document, each as soon as its diagonal ends.

    ``active`` holds the lags that match up to the present word and for how many words. A word that equals the
    one a lag earlier makes that lag's match longer by one; else the diagonal ends, and is a run if long enough. New
    lags come from ``opens``, by the position of the word; they are followed back to where their match began.
    """
    active: dict[int, int] = {}
    last = len(words)
    for i in range(min(opens), last) if opens else ():
        if active:
            w = words[i]
            for lag in [d for d in active if words[i - d] != w]:
                n = active.pop(lag)
                if n + lag >= max(LEAST, TIMES * lag):
                    yield i - n - lag, n + lag, lag
            for lag in active:
                active[lag] += 1
        for lag, n in opens.get(i, ()):
            if lag not in active:
                while i - n - lag >= 0 and words[i - n] == words[i - n - lag]:
                    n += 1
                active[lag] = n
    for lag, n in active.items():
        if n + lag >= max(LEAST, TIMES * lag):
            yield last - n - lag, n + lag, lag


def repeated(words: list, doc_id: int) -> list:
    """The contract's planted repetition: one document in ten, by a hash of its id, goes round in its own words."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def _solve(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """The runs, by start and period, and the collapsed text of each list of words."""
    number: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            if w not in number:
                number[w] = len(number)
    flat = np.fromiter((number[w] for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    # Words of two documents never share a number; those that a document has once match nothing.
    local = _named(doc * (len(number) + 1) + flat)
    repeats = np.flatnonzero(local >= 0)
    found: dict[int, dict[int, list[tuple[int, int]]]] = {}
    # Positions of once-only words are given numbers of their own, so that positions stay those of the documents.
    local[local < 0] = int(local.max(initial=-1)) + 1 + np.arange(len(local) - len(repeats))
    for at, lag, k in openings(local, doc):
        for i, d in zip(at.tolist(), lag.tolist(), strict=True):
            j = int(doc[i])
            found.setdefault(j, {}).setdefault(i - int(first[j]), []).append((d, k))
    for j, t in enumerate(texts):
        if j not in found:
            yield [], b" ".join(t)
            continue
        runs = sorted((s, n, q) for s, n, q in runs_online(flat[first[j] : first[j] + len(t)].tolist(), found[j]))
        runs.sort(key=lambda r: (r[0], r[2]))
        dropped = bytearray(len(t))
        for s, n, q in runs:
            dropped[s + q : s + n] = b"\1" * (n - q)
        yield runs, b" ".join(w for w, out in zip(t, dropped, strict=True) if not out)


def find_runs(docs: DataFrame, altered: Callable[[list, int], list] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the maximal periodic runs of each whole text, by start and period, and the text without their repeats.

    A run is a longest stretch of words of smallest period q, of ``max(24, 3 q)`` words at least. Words are split at
    ASCII white space; ``altered`` may change a document's words before, given its doc_id. A map over texts without a
    shuffle; a document of any length takes n log n steps, as each position opens at most one lag a scale and few lags
    of a scale can be active at once. Edge cases: a null or empty text has no runs and collapses to an empty one; so
    many runs may overlap; repeated rows and null doc_ids (never altered) are rows of their own; other columns are
    ignored; an empty table gives no row.
    """

    @released
    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (data or b"").split()
                ids.append(doc_id)
                texts.append(altered(words, doc_id) if altered and doc_id is not None else words)
                held += len(words) + 1
                if held >= GROUP:
                    yield from _rows(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from _rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _rows(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    kept: tuple[list, list, list] = ([], [], [])
    held = 0
    for doc_id, (runs, text) in zip(ids, _solve(texts), strict=True):
        for column, value in zip(kept, (doc_id, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text.decode()), strict=True):
            column.append(value)
        held += len(text) + 64 * len(runs)
        if held > OUT_BYTES:
            yield _record(kept)
            kept, held = ([], [], []), 0
    if kept[0]:
        yield _record(kept)


def _record(kept: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], _RUNS), pa.array(kept[2], pa.string())], ["doc_id", "runs", "collapsed"])


def digest(found: DataFrame) -> DataFrame:
    """One row a document: its number of runs, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    # length / period compared exactly: products of word counts fit a long.
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.element_at("runs", 1), lambda acc, x: F.when(better(x, acc), x).otherwise(acc)))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
