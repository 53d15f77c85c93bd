"""Paper corpora: chunks, links to stars and clusters, consistency with catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.functions.stellar import bp_rp, total_motion
from starloom.plans.durable import durable

#: Most cluster terms that every text is searched for one by one; more are joined.
FEW_TERMS = 200


def pieces(text: str | None, size: int = 1000, overlap: int = 200) -> Iterator[str]:
    """Overlapping pieces of a text that end at the last full stop beyond 80 percent of ``size``."""
    start = 0
    while text and start < len(text):
        piece = text[start : start + size]
        dot = piece.rfind(".")
        if start + size < len(text) and dot > size * 0.8:
            piece = piece[: dot + 1]
        yield piece
        if start + len(piece) >= len(text):
            break
        start += max(1, len(piece) - overlap)


def chunk_text(df: DataFrame, key: str = "arxiv_id", column: str = "abstract", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_no, chunk): the pieces of each text.

    Where a piece ends depends on the one before, so this runs in tasks over Arrow batches.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"k": k, "chunk_no": n, "chunk": piece} for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, piece in enumerate(pieces(text, size, overlap))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return df.select(F.col(key).cast("string").alias("k"), column).mapInArrow(cut, "k string, chunk_no long, chunk string").withColumnRenamed("k", key)


#: Most rows that a limit takes through one task.
FEW_ROWS = 10_000


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order that tells all rows apart; a large ``n`` takes whole ranges of a range partition, and one in part."""
    if n <= FEW_ROWS:
        return df.orderBy(*order).limit(n)
    if df.count() <= n:
        return df
    placed = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = 0
    for at, rows in sorted(placed.groupBy("_range").count().collect()):  # one row a range
        if rows > n:
            break
        whole, n = at + 1, n - rows
    rest = placed.where(F.col("_range") == at).orderBy(*order).limit(n)
    return placed.where(F.col("_range") < whole).unionByName(rest).drop("_range")


def build_corpus(raw: DataFrame, existing: DataFrame, target: int) -> DataFrame:
    """New papers up to a target: id after /abs/, three authors, embedding text; raw has url, title, abstract, authors, query_no, rank, category."""
    p = raw.withColumn("arxiv_id", F.substring_index("url", "/abs/", -1)).withColumn("authors", F.slice("authors", 1, 3))
    first = Window.partitionBy("arxiv_id").orderBy("query_no", "rank")
    fresh = p.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(existing.select("arxiv_id"), "arxiv_id", "left_anti")
    return first_rows(fresh, ["query_no", "rank", "arxiv_id"], target).withColumn("embed_text", F.concat_ws(". ", "title", "abstract"))


def link_stars_papers(papers: DataFrame, stars: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(source_id, arxiv_id, strategy): ids in the text that are stars, and names that resolve to one (names: name, source_id)."""
    ids = papers.select("arxiv_id", F.explode(tx.gaia_ids_near("abstract")).alias("source_id")).withColumn("strategy", F.lit("gaia_id"))
    links = ids.join(stars.select("source_id"), "source_id", "left_semi").select("source_id", "arxiv_id", "strategy")
    if names is not None:
        found = papers.select("arxiv_id", F.explode(tx.catalog_ids("abstract")).alias("n")).withColumn("name", F.lower(F.replace("n", F.lit(" "), F.lit(""))))
        known = names.select(F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("name"), "source_id")
        links = links.unionByName(found.join(known, "name").select("source_id", "arxiv_id", F.lit("entity").alias("strategy")))
    return links.distinct()


#: Characters of a gram, the unit of the inverted index.
GRAM = 8
#: Most distinct grams that are broadcast to the texts; more are joined as Spark sees fit.
BROADCAST_GRAMS = 500_000


def grams(value, lengths: list[int], of: str = ".") -> Column:
    """The distinct runs of each of the lengths (characters) that a text holds; ``of`` is a regular expression of the characters that they are of."""
    runs = [F.regexp_extract_all(value, F.lit(f"(?s)(?=({of}{{{n}}}))"), 1) for n in lengths] or [F.array().cast("array<string>")]
    return F.array_distinct(F.concat(*runs))


#: Most distinct characters that a pattern lists; grams of more are cut from texts whatever they are of.
LISTED_CHARACTERS = 1_000


def characters(wanted: DataFrame) -> str:
    """A regular expression of the characters that grams (gram) are of."""
    letter = wanted.select(F.explode(F.array_distinct(F.split("gram", ""))).alias("c")).where("c <> ''").distinct()
    found = sorted({ord(x) for r in letter.limit(LISTED_CHARACTERS + 1).collect() for x in r.c})
    return "[" + "".join(f"\\x{{{x:x}}}" for x in found) + "]" if 0 < len(found) <= LISTED_CHARACTERS else "."


def gram_postings(texts: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, text_key): the inverted index of texts (text_key, body) over the grams of ``wanted`` (gram); no row carries a body.

    Only runs of characters that wanted grams have are cut from the texts, so a text without them costs one look at each character.
    """
    small = wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return texts.select("text_key", F.explode(grams("body", lengths, characters(wanted))).alias("gram")).join(F.broadcast(wanted) if small else wanted, "gram", "left_semi").distinct()


def term_candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, term, gram, held_by): texts (text_key, body) that hold the rarest gram, and all others, of distinct terms (term).

    A term's grams are its runs of ``GRAM`` characters, or itself if it is shorter. Each gram is counted over the texts, and over
    the terms; a term is keyed by the gram that the fewest texts hold, of equals that of the fewest terms, so names that share
    a beginning are told apart by what follows it. A term with a gram that no text holds is in none. What meets by the rarest gram stays only
    if the text holds the term's other grams too; texts of the postings have their keys alone.
    """
    term = F.col("term")
    own = terms.select(term, F.when(F.char_length(term) <= GRAM, F.array(term)).otherwise(grams(term, [GRAM])).alias("grams"))
    lengths = [r[0] for r in terms.select(F.least(F.char_length(term), F.lit(GRAM)).alias("n")).distinct().collect()]  # eight at most
    listed = own.select("term", F.explode("grams").alias("gram"))
    asked = listed.groupBy("gram").agg(F.count("*").alias("terms"))
    # One pass over the texts; what is left of it is small beside them and read three times.
    postings = durable(gram_postings(texts, asked.select("gram"), lengths), "postings")
    held = postings.groupBy("gram").agg(F.count("*").alias("held_by")).join(asked, "gram")
    of = listed.join(held, "gram", "left").withColumn("held_by", F.coalesce("held_by", F.lit(0).cast("long")))
    best = of.groupBy("term").agg(F.min(F.struct("held_by", "terms", "gram")).alias("b"), F.count("*").alias("n"))
    keyed = best.where("b.held_by > 0").select("term", "n", F.col("b.gram").alias("gram"), F.col("b.held_by").alias("held_by"))
    met = keyed.join(postings, "gram")
    more = met.where("n > 1").join(listed.withColumnRenamed("gram", "_other"), "term").join(postings.withColumnRenamed("gram", "_other"), ["_other", "text_key"])
    full = more.groupBy("text_key", "term", "gram", "held_by", "n").agg(F.count("*").alias("_found")).where(F.col("_found") == F.col("n"))
    return met.where("n = 1").select("text_key", "term", "gram", "held_by").unionByName(full.select("text_key", "term", "gram", "held_by"))


def texts_with_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of texts (body, ...) and terms (term, ...) with the term inside the body; an empty term is in none.

    Candidates come from an inverted index on the rarest grams (``term_candidates``), over hashes of the texts;
    bodies are joined after that, once a candidate, and the whole term decides. Texts that share a hash are tried alike.
    """
    terms = terms.where("term <> ''")
    keyed = texts.where(F.col("body").isNotNull()).withColumn("_key", F.xxhash64("body"))
    pairs = term_candidates(keyed.select(F.col("_key").alias("text_key"), "body"), terms.select("term").distinct()).select(F.col("text_key").alias("_key"), F.col("term").alias("_term")).distinct()
    said = pairs.join(keyed, "_key").where(F.expr("contains(body, _term)")).drop("_key")
    return said.join(terms, said["_term"] == terms["term"]).drop("_term")


def link_papers_clusters(papers: DataFrame, regions: DataFrame, aliases: dict = tx.CLUSTERS) -> DataFrame:
    """(arxiv_id, cluster, term): a region's first alias that any paper holds finds all its papers."""
    rows = [(name, i, term) for name, terms in aliases.items() for i, term in enumerate(terms)]
    table = regions.sparkSession.createDataFrame(rows, "key string, term_no int, term string")
    terms = regions.select(F.col("name").alias("cluster"), F.lower("name").alias("key")).join(table, "key", "left").select("cluster", F.coalesce("term_no", F.lit(0)).alias("term_no"), F.coalesce("term", "key").alias("term"))
    body = F.lower(F.concat_ws(" ", "title", "categories", "abstract"))
    texts = papers.select("arxiv_id", body.alias("body"))
    small = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    found = texts.join(F.broadcast(terms.where("term <> ''")), F.expr("contains(body, term)")) if small else texts_with_terms(texts, terms)
    hits = found.select("arxiv_id", "cluster", "term_no", "term")
    first = hits.groupBy("cluster").agg(F.min("term_no").alias("term_no"))
    return hits.join(first, ["cluster", "term_no"]).select("arxiv_id", "cluster", "term").distinct()


def link_alerts_papers(alerts: DataFrame, papers: DataFrame) -> DataFrame:
    """(name, arxiv_id): alert names, blanks and all, that titles or abstracts hold in any case of letters."""
    texts = papers.select("arxiv_id", F.explode(F.array_compact(F.array(F.lower("title"), F.lower("abstract")))).alias("body"))
    return texts_with_terms(texts, alerts.select("name", F.lower("name").alias("term")).distinct()).select("name", "arxiv_id").distinct()


def consistency(pairs: DataFrame) -> DataFrame:
    """Add consistency_score, status, n_matches and n_conflicts to rows that hold a star's columns and a paper's title and abstract."""
    body = F.concat_ws(" ", "abstract", "title")
    ruwe, motion, colour = F.col("ruwe"), total_motion(), bp_rp()
    binary = tx.mentions(body, "binary") & ruwe.isNotNull()
    fast = tx.mentions(body, "high_motion") & motion.isNotNull()
    young = tx.mentions(body, "young") & ((colour > 1.5) | (colour < 0.5))
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(type(v)(0))
    score = yes(binary & (ruwe > 1.4), 0.4) - yes(binary & (ruwe <= 1.4), 0.2) + yes(fast & (motion > 50), 0.4) - yes(fast & (motion <= 50), 0.2) + yes(young, 0.3)
    out = pairs.withColumn("consistency_score", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 2))
    out = out.withColumn("n_matches", yes(binary & (ruwe > 1.4), 1) + yes(fast & (motion > 50), 1) + yes(young, 1)).withColumn("n_conflicts", yes(binary & (ruwe <= 1.4), 1) + yes(fast & (motion <= 50), 1))
    return out.withColumn("status", F.when(F.col("consistency_score") > 0, "consistent").when(F.col("consistency_score") == 0, "uncertain").otherwise("conflicting"))


def consistency_by_star(checked: DataFrame) -> DataFrame:
    return checked.groupBy("source_id").agg(F.round(F.avg("consistency_score"), 2).alias("consistency"), F.count("*").alias("papers"))
