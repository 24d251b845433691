"""A corpus pipeline: toxicity, exact and near duplicates, secrets, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from subsetry.llm import common, exact_dedup, near_dedup, packing, secret_scan, toxicity


# Each stage takes a null text as an empty one and keeps the columns of docs, extra ones too. Repeated
# rows are treated alike, but for exact copies, of which one row stays. An empty table gives an empty
# one. Texts of any length are read whole.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.7); all of them without labels of both classes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_ordinary(docs, labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z in lower case, the row with the largest doc_id; a null id is below all others."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those whose five-word shingles are 0.8 or more alike to one that stays.

    Of a group the document with the most mates stays, of several the smallest doc_id (null first).
    Pairs share a class of the SimHash operator or a MinHash band, as the fingerprints of most
    pairs at 0.8 differ in more bits than their tries can be joined at; all are verified by their shingles.
    """
    return near_dedup.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted again; a null text stays null."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, packed into sequences; a null or empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]

#: The stages with models, fingerprints, redaction and token ids are beyond SQL; tests/llm holds
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again.

    What a stage staged on its way is deleted once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.settled(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
