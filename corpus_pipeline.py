"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again for the next.

Cases, for all stages: an empty table gives an empty result; other columns, whatever their names, pass through the stages that return
documents; null texts are empty texts (not toxic, of no language: the language stage drops them); rows that repeat are rows of their own
until the near-duplicate stage keeps one; a null doc_id is kept until then, and only where its group has no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieve.llm import langid, mixing, packing, simhash, toxicity
from sieve.llm.common import ship_package
from sieve.staging import stage_result


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    network = toxicity.train(toxicity.labelled_documents(docs, _labels(spark, sf_dir)))
    return toxicity.drop_toxic(docs, network)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language of each whole text is predicted; it becomes the document's ``lang`` where that is null. Documents without a
    language go: no letter, or no word of which the model knows as much as a letter."""
    return langid.drop_unidentified(docs, langid.train(docs.where(~langid.held_out(4, 2))), lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: documents are taken whole, up to twice, good ones first."""
    return mixing.mixed_documents(docs, quality=_labels(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The trained and hashed stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:  # what a stage wrote on its way goes once its result is written
        docs = stage_result(spark, lambda step=step, docs=docs: step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
