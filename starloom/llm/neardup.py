"""Near-duplicates by bottom-k sketches from one hash function, confirmed by exact Jaccard similarity."""

from __future__ import annotations

import math
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm import shingles, workers
from starloom.llm.components import connected_components
from starloom.llm.names import unused
from starloom.llm.skew import LEAST, parts_of, spread_join, with_parts
from starloom.plans.durable import durable

#: Values kept of each set.
SKETCH = 64
#: Chance that a linked pair shares fewer retained values than its lists ask for.
MISS = 1e-9
#: Most ids (16 bytes each) that are broadcast to pick out documents; beyond it the documents are shuffled.
BROADCAST_IDS = 500_000
#: Longest list whose members are tried pair by pair; the members of longer ones go by lists over their full sets.
SHORT = 16
#: Members of a list that one task pairs with its others.
PART = 2_000


@lru_cache
def least_overlap(k: int, similarity: float) -> int:
    """Retained values that two linked sets share but for a chance of ``MISS``.

    The k smallest hashes of the union are a uniform draw from it, each in both sets with a chance of
    the similarity, and such a value is retained by both.
    """
    total = 0.0
    for c in range(k + 1):
        total += comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if total > MISS:
            return max(1, c)
    return k


def sketches(docs: DataFrame, width: int = 5, k: int = SKETCH) -> DataFrame:
    """(doc_id, n, print, sketch): set size, a fingerprint of the whole set, and its k smallest hashes."""

    @workers.released
    def make(batches):
        for ids, sets in _sets(batches, width):
            n = pa.array(map(len, sets), pa.int64())
            prints = pa.array(map(shingles.fingerprint, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, n, prints, _lists([v[:k] for v in sets])], ["doc_id", "n", "print", "sketch"])

    return _texts(docs).mapInArrow(make, "doc_id long, n long, print binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(print, values): the fingerprint and every hash of each row's set."""

    @workers.released
    def make(batches):
        for _, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(map(shingles.fingerprint, sets), pa.binary()), _lists(sets)], ["print", "values"])

    return _texts(docs).mapInArrow(make, "print binary, values array<long>")


def set_print(text, width: int = 5):
    """A Column: the fingerprint of a text's set."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(map(shingles.fingerprint, shingles.shingle_sets(texts, width)), pa.binary())

    return made(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _sets(batches, width: int):
    """(ids, shingle sets) of a few hundred documents at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            yield part.column(0), list(shingles.shingle_sets(part.column(1), width))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _prefixes(kept: DataFrame, least) -> DataFrame:
    """(value, id, n, weight, place, parts): each set under the rarest of its values that a linked set must share.

    Two sets that share c of their values share one of the first (kept - c + 1) of either in any common
    order; ``least`` is c. In the order of rarity those are seldom values of passages that many documents
    share, whose lists would be long. Values of one set alone have no list. ``weight`` is the length of
    all the set's lists together, which is large for the middle of a group of copies; ``parts`` is the number of tasks
    that a list is dealt to.
    """
    frequency = durable(kept.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    parts = parts_of(frequency, "value", "df", frequency.agg(F.sum("df")).first()[0] or 0)
    own = Window.partitionBy("id")  # at most the values of one set
    return (
        spread_join(with_parts(kept, "value", parts), with_parts(frequency, "value", parts), "value", by="id")
        .withColumn("alone", F.col("kept") - F.count("*").over(own))
        .withColumn("weight", F.sum("df").over(own))
        .withColumn("place", F.row_number().over(own.orderBy("df", "value")) + F.col("alone"))
        .where(F.col("place") <= F.col("kept") - least + 1)
        .select("value", "id", "n", "weight", "place", "parts")
    )


def sketch_lists(reps: DataFrame, similarity: float, k: int) -> DataFrame:
    """Inverted lists of retained values; they bring linked sets together but for a chance of ``MISS``."""
    whole = int(k * similarity)  # up to here any partner's set is retained whole, and the similarity decides
    least = F.when(F.col("n") <= whole, F.ceil(F.col("n") * similarity)).otherwise(F.lit(least_overlap(k, similarity)))
    return _prefixes(reps.select("id", "n", F.least(F.col("n"), F.lit(k)).alias("kept"), F.explode("sketch").alias("value")), least)


def full_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists over full sets, where sets of the similarity always meet; they hold a quarter of each set."""
    n = F.size("values").cast("long")
    return _prefixes(sets.select("id", n.alias("n"), n.alias("kept"), F.explode("values").alias("value")), F.ceil(F.col("n") * percent / 100))


def _sizes_fit(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _ends(pairs: DataFrame) -> dict[str, DataFrame | None]:
    """For both ends of pairs (a written table) the ids in very many of them, with the tasks that these are dealt to."""
    total = pairs.count()
    counts = {x: pairs.groupBy(x).agg(F.count("*").alias("n_pairs")) for x in "ab"}
    return {x: parts_of(counts[x], x, "n_pairs", total) if total > LEAST else None for x in "ab"}


def _with_sides(pairs: DataFrame, ends: dict, sides: DataFrame, name: str) -> DataFrame:
    """(a, b) with the ``name`` of both ids (sides: id, ``name``) as ``{name}a`` and ``{name}b``.

    The centre of a group of copies is in as many pairs as the group has members: its side is copied to several
    tasks, and its pairs are dealt to them.
    """
    for end, other in ("ab", "ba"):
        side = sides.select(F.col("id").alias(end), F.col(name).alias(f"{name}{end}"))
        pairs = spread_join(with_parts(pairs, end, ends[end]), with_parts(side, end, ends[end]), end, by=other).drop("parts")
    return pairs


def with_estimate(pairs: DataFrame, ends: dict, reps: DataFrame, k: int) -> DataFrame:
    """Add ``estimate`` to (a, b): the share of the union's k smallest hashes that both sets hold."""
    # Hashes are stored signed; flipping the top bit puts them back in unsigned order.
    order = lambda s: F.transform(s, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    lowest = F.slice(F.array_sort(order(F.array_union("sketcha", "sketchb"))), 1, k)
    both = F.size(F.array_intersect(lowest, order(F.array_intersect("sketcha", "sketchb"))))
    return _with_sides(pairs, ends, reps.select("id", "sketch"), "sketch").withColumn("estimate", both / F.size(lowest)).drop("sketcha", "sketchb")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of some doc_ids (a written table); their texts are not shuffled while the ids are few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def sets_of(classes: DataFrame, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, values) of some classes (a written table of ids), each read from a row of its first doc_id that has its fingerprint."""
    wanted = durable(classes.join(ids, "id", "left_semi").select("id", "print", F.col("first").alias("doc_id")), "wanted")
    prints = wanted.select("id", "print")
    if wanted.count() <= BROADCAST_IDS:
        prints = F.broadcast(prints)
    return full_sets(_only(docs, durable(wanted.select("doc_id").distinct(), "firsts")), width).join(prints, "print").dropDuplicates(["print"]).select("id", "values")


def confirm(pairs: DataFrame, ends: dict, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= percent * union.

    The pair's sets meet through two joins, so no group of pairs is gathered in a task.
    """
    needed = durable(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    sets = durable(sets_of(classes, docs, needed, width), "sets")
    met = _with_sides(pairs.select("a", "b"), ends, sets, "values").withColumn("i", F.size(F.array_intersect("valuesa", "valuesb")).cast("long"))
    return met.where(100 * F.col("i") >= percent * (F.size("valuesa") + F.size("valuesb") - F.col("i"))).select("a", "b").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after more links: only the labels that these join are gone through again."""
    end = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(end("a"), "a").join(end("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = connected_components(between).select(F.col("id").alias("label"), "component")
    return labels.join(moved, "label", "left").select("id", F.coalesce("component", "label").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the
    smallest doc_id that a document reaches, and the document of that id is kept.

    1. Equal sets are one class with an id of its own, so exact copies cost one row each from here on, and rows that
       repeat a doc_id with other texts are apart. Its smallest doc_id comes in again at the end.
    2. Representatives meet in the inverted lists of their retained values. A list does not pair all its
       members: first they are tried against its most central one, which is one pair per posting and
       joins a group of copies at once.
    3. What is then still apart in a list of up to ``SHORT`` members is tried pair by pair. Members of longer
       lists get lists over their full sets, where they need not meet over a passage that is less than
       three quarters of them; those lists are gone through in the same two steps, to the last pair.
    4. Pairs first pass set sizes and the union-sketch estimate (with a slack that makes the loss of a
       true link below ``MISS``), then the exact similarity of their full sets.

    With ``exact`` all representatives get lists over their full sets and no pair goes by its sketches: no link is
    left to chance, for lists of a quarter of all shingles in place of 64 values a set.

    Every join that a common value, a large group of equal sets or the centre of a large group takes part in is dealt over
    as many tasks as its rows ask for (``skew.spread_join``).

    Edge cases: null and empty texts, and texts without words, have an empty set and no link; a document
    of fewer than ``width`` words has its whole sequence as one shingle; rows that repeat a doc_id are rows of their
    own, each with the links of its text; a null doc_id has no links and is kept; an empty table gives no row; other
    columns are ignored.
    """
    return _members(docs, percent, width, k, exact).select("doc_id", "n_shingles", "component_id", "kept")


def _members(docs: DataFrame, percent: int = 75, width: int = 5, k: int = SKETCH, exact: bool = False) -> DataFrame:
    """What ``near_duplicates`` says, with the fingerprint of each row's set and the ``label`` of its component (null: an empty set)."""
    similarity = percent / 100
    with workers.small_batches(docs.sparkSession):
        made = durable(sketches(docs, width, k), "sketches")
    # Rows of one fingerprint have one size and one sketch.
    rows = made.where("n > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_print"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = durable(rows.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = reps.drop("sketch")
    member = made.select("doc_id", "n", "print")
    lists = None if exact else durable(sketch_lists(reps, similarity, k), "lists")
    least = least_overlap(k, similarity) / k
    tried = None
    labels = durable((classes if exact else lists).select("id").distinct().withColumn("label", F.col("id")), "labels")

    def settle(pairs: DataFrame) -> None:
        """Verify pairs of representatives and bring the labels up to date."""
        nonlocal tried, labels
        new = durable(pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti"), "met")
        if not new.head(1):
            return
        ends = _ends(new)
        fit = new if exact else durable(with_estimate(new, ends, reps, k).where(F.col("estimate") >= least).select("a", "b").distinct(), "pairs")
        tried = fit if tried is None else tried.union(fit)
        if not fit.head(1):
            return
        labels = durable(_joined(labels, durable(confirm(fit, ends, classes, docs, width, percent), "links")), "labels")

    def open_lists(all_lists: DataFrame) -> DataFrame:
        """Lists that still hold more than one component, with their lengths."""
        now = all_lists.join(labels, "id")
        several = now.groupBy("value").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("length"), F.max("parts").alias("parts")).where("l1 < l2").select("value", "length", "parts")
        return durable(spread_join(now, several, "value", by="id"), "open")

    def star(all_lists: DataFrame) -> DataFrame:
        """Each list's most central member with each other member."""
        top = all_lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("top"), F.max("parts").alias("parts"))
        centre = top.select("value", (-F.col("top.minus")).alias("centre"), F.col("top.n").alias("n_centre"), "parts")
        met = spread_join(all_lists, centre, "value", by="id").where((F.col("id") != F.col("centre")) & _sizes_fit("n", "n_centre", percent))
        return met.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))

    def across(rest: DataFrame, whole: bool) -> DataFrame:
        """Pairs of a list's members in different components.

        Members meet by classes of size, as linked sets are of one class or of two next to each other, and the members of a
        long list are dealt over several tasks, to each of which the others are copied. In lists over whole sets, a pair for
        which this is the first common value has at most what follows the value in either set in common, and is left out
        where that is too little for a link.
        """
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / similarity) + 1e-9)).cast("long")
        tasks = F.ceil(F.col("length") / PART)
        one = rest.withColumn("size", size).withColumn("part", F.pmod(F.xxhash64("id"), tasks))
        two = rest.withColumn("size", F.explode(F.array(size - 1, size, size + 1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)))
        one, two = (side.select("value", "size", "part", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "label", "place"))) for side, x in ((one, "a"), (two, "b")))
        fit = (F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & _sizes_fit("n_a", "n_b", percent)
        if whole:
            most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
            fit &= (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
        return one.join(two, ["value", "size", "part"]).where(fit).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    if exact:
        long = labels.select("id")
    else:
        settle(star(lists))
        rest = open_lists(lists)
        settle(across(rest.where(F.col("length") <= SHORT), whole=False))
        long = durable(rest.where(F.col("length") > SHORT).select("id").distinct(), "long")
    if long.head(1):
        fine = durable(full_lists(sets_of(classes, docs, long, width), percent), "full-lists")
        settle(star(open_lists(fine)))
        settle(across(open_lists(fine), whole=True))
    n_labels = parts_of(labels.groupBy("label").agg(F.count("*").alias("n_ids")), "label", "n_ids", labels.count())
    firsts = labels.join(classes.select("id", "first"), "id").groupBy("label").agg(F.min("first").alias("component"))
    named = spread_join(with_parts(labels, "label", n_labels), with_parts(firsts, "label", n_labels), "label", by="id").drop("parts")
    n_equal = parts_of(classes, "id", "n_print", made.count())
    names = with_parts(classes.join(named, "id", "left").select("print", "id", F.coalesce("label", "id").alias("label"), F.coalesce("component", "first").alias("component")), "id", n_equal).drop("id")
    if n_equal is None:
        out = member.join(names.drop("parts"), "print", "left")
    else:  # the rows of a large class are dealt over several tasks
        hot = F.broadcast(classes.join(F.broadcast(n_equal), "id").select("print", "parts"))
        out = spread_join(member.join(hot, "print", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))), names, "print", by="doc_id", how="left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "print", F.when(F.col("n") > 0, F.col("label")).alias("label"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, with the columns that it came with.

    It is of the smallest doc_id. Of rows that repeat this doc_id, one stays for each group that they are in; rows
    without a set or a doc_id all stay.
    """
    members = durable(_members(docs, **options).where("doc_id IS NOT NULL"), "members")
    fates = durable(members.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.bool_or("kept").alias("kept")).where("kept OR n_rows > 1"), "fates")
    named = docs.where(F.col("doc_id").isNotNull())
    out = _only(named, durable(fates.where("n_rows = 1").select("doc_id"), "kept")).select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
    several = durable(fates.where("n_rows > 1").select("doc_id"), "several")
    if not several.head(1):
        return out
    mark, label, key, empty = unused(docs.columns, "print", "label", "key", "empty")
    repeated = _only(named, several).select(*docs.columns).withColumn(mark, set_print("text", options.get("width", 5)))
    groups = members.where("kept").join(several, "doc_id").select(F.col("doc_id").alias(key), F.col("print").alias(mark), F.col("label").alias(label), F.col("label").isNull().alias(empty)).distinct()
    stay = repeated.join(groups, [F.col("doc_id").cast("long") == F.col(key), repeated[mark] == groups[mark]]).drop(groups[mark])
    return out.union(stay.where(empty).select(*docs.columns)).union(stay.where(~F.col(empty)).dropDuplicates([key, label]).select(*docs.columns))
