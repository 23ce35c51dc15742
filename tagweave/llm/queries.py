"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import bktree, hilbert, huffman, langid, licenses, mixing, packing, pii, simhash, toxicity
from tagweave.llm.common import crc_mod, read


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.array_join("toxic_words", ",").alias("toxic_words"))


def op2_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_pairs(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licenses.digest(licenses.scan(docs, licenses.build_index(docs)))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = mixing.mix(docs, mixing.default_levels(), mixing.WEIGHTS, budget=0.5, max_epochs=2)
    return out.select("doc_id", mixing.domain_of().alias("domain"), "lang", "source", "epoch", "take")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.huffman_round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), special=True)


#: A deployment has its own key; this one makes results repeatable.
PII_KEY = "tagweave example key"


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", *(F.col("pseudonyms")[k].alias(f"n_{k}") for k in pii.KINDS))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(crc_mod("doc_id", 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_bk_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.simhash_components(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(read(spark, sf_dir, "documents"), tokenizer_path(), special=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash_fingerprints, op3_license_scan, op4_source_mixing, op5_token_files, op6_pii_pseudonyms, op7_language_id, op8_hilbert_neighbours, op9_bk_tree_near_dedup, op10_best_fit_packing)
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLE_SQL: dict[str, str] = {}
