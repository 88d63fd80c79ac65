"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared
folder and reads them again as the next one's docs. All stages but the last return the columns of documents.

Defined cases, for every stage: an empty table gives no rows; null text is the empty text, which language_id rejects; further
columns are carried through, whatever their names, to the last stage, which drops them; a null doc_id, source or lang does no harm.
Rows that share a doc_id: language_id and packing take each by itself; exact_dedup decides by text and keeps all rows of an id of
which one text stays; near_dedup takes them for one document; mixing places them together, at the first of their places.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import common, exact_dedup, langid, mixing, near_dedup, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null text and text without a letter, by that test alone: code lengths choose a language but reject nothing."""
    return langid.recognised(docs, langid.learn(langid.trainable(docs)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; rows equal in both stay together."""
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity 0.8 or more. Texts without words
    are near nothing and stay."""
    return near_dedup.survivors(docs, words=5, similarity=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows that follow the Pfair schedule of their sources."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their token ids. Each task packs the files it reads in their
    order; sequences of different tasks have no order among them."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL can express neither the language model nor the cuts into pieces; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = common.documents(spark, sf_dir), common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.settled(functools.partial(stage, spark, docs, sf_dir), f"stage-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
