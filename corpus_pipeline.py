"""From raw documents to packed sequences: five operators in a row.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the ``docs`` of the next. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendastat.llm import exact_dedup, language_id, mixing, order_minhash, packing
from vendastat.llm.common import store
from vendastat.llm.queries import TOKENIZER, table

#: Documents whose language is less certain go. Four languages alike would have 0.25 each.
MIN_LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or no language that stands out."""
    return language_id.recognised(docs, MIN_LANGUAGE_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, but for the case of A to Z."""
    return exact_dedup.drop_copies(docs, normalise=exact_dedup.ascii_lower)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return order_minhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Language ID, MinHash and the tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
