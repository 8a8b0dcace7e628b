"""From raw documents to packed sequences: the stages of one corpus run, in order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it decides takes
effect on the documents it returns, with all their columns but for the last, which returns pieces.

Defined cases: null, empty and blank texts fail the quality rules and go; of repeated rows and exact or near
copies the one with the smallest doc_id stays, rows without doc_id stay or go together; a document whose
whole text is cut out stays with an empty text until mixing, where a cell without tokens is not drawn; null
lang or source is a category of its own; extra columns are carried to the fourth stage; an empty table
gives an empty table of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup
from strandloom.llm.storage import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 200 bytes or more that stands anywhere else is cut out of the texts."""
    return suffix_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come in their target shares."""
    return source_mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("packing", packed),
]

#: Fingerprints, byte windows and token ids have no form in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage-{number + 1}")
    return docs
