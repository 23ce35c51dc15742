"""A training corpus from raw documents, in five stages of the operators in ``tagweave.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The last returns the
pieces of the packed sequences, the others documents with the columns of the table.

Null and empty texts have no language and go in the first stage; in the others they stay as they are. Null ids
stay to the end; repeated ids are one document after near-dedup; an empty table goes through empty; other
columns than those of the table are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import common, jaccard, langid, mixing, packing, pii, queries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.5
MIX_BUDGET, MIX_EPOCHS = 0.8, 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on, with the language found; others are rejected."""
    model = langid.learn(docs)
    found = langid.predict(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of rows that repeat an id, one.

    Near-duplicates are texts whose SimHashes differ in three bits or fewer, and texts with a Jaccard likeness of 0.8
    or more, both of five-word shingles. Rows without an id stay, their texts are in no group.
    """
    groups = jaccard.jaccard_components(docs, 0.8, words=5, radius=3)
    ids = groups.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    stay = common.materialise(ids.where("doc_id = component_id").select("doc_id", "n"), "stay")
    kept = docs.select(*COLUMNS).join(stay.hint("merge"), "doc_id")
    once, again = kept.where("n = 1").drop("n"), kept.where("n > 1").drop("n").dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced by pseudonyms of the same format."""
    out = pii.pseudonymise(docs.select(*COLUMNS), queries.PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take; the document at the end of a leaf's prefix stays whole."""
    out = mixing.mix(docs.select(*COLUMNS), mixing.default_levels(), mixing.WEIGHTS, budget=MIX_BUDGET, max_epochs=MIX_EPOCHS)
    return out.select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_sequences(docs, queries.tokenizer_path(), special=True)


STAGES = [("language", language), ("near-dedup", near_dedup), ("pseudonyms", pseudonyms), ("mixture", mixture), ("sequences", sequences)]

#: Language models, pseudonyms and BPE can't be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{name}")
    return docs
