"""Queries of this subpackage, one per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.tables import table
from starloom.llm import bpe, decontam, gnat, licenses, mixing, neardup, periods, sharding, templates, tokens, toxicity, voronoi, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), exponent=0.5, epochs=1.0, seed=42).select("doc_id", "source", "lang", "n_chars", "text", "copy_no", "shuffle_key")


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), shards=40)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_main_text(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=75, width=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score").withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op9_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(voronoi.quantised(table(spark, sf_dir, "embeddings")), k=20)


def op10_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op11_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_and_decode(table(spark, sf_dir, "documents"), word_tokenizer_path()))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.find_runs(table(spark, sf_dir, "documents"), altered=periods.repeated))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.hard_negatives(gnat.prepared(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_html_templates": op4_html_templates,
    "op5_license_scan": op5_license_scan,
    "op6_token_output": op6_token_output,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_toxicity": op8_toxicity,
    "op9_voronoi_topk": op9_voronoi_topk,
    "op10_warc_boundary_chain": op10_warc_boundary_chain,
    "op11_streaming_bpe": op11_streaming_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_poisson_mixing": mixing.ORACLE,
    "op9_voronoi_topk": voronoi.ORACLE,
    "op10_warc_boundary_chain": warc.ORACLE,
    "op13_hard_negatives": gnat.ORACLE,
}
