"""The training-data pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, of any name and kind, untouched but for text; the last one leaves out all but doc_id and text. An empty
table gives an empty table. A text of any length is handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from canopylens.llm import jaccard_join, line_dedup, mixing, packing, quality
from canopylens.llm.common import cut, table

#: The vocabulary that the last stage packs for.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail or lost too much.

    Null and empty texts fail. Repeated rows are judged alike, each by itself; there are no ties.
    """
    return quality.stage(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go, but for their first place, and documents of which nothing is left.

    Null and empty texts stay. Of repeated rows and equal passages the first in order of doc_id, then of row, keeps its text.
    """
    return line_dedup.stage(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one of the smallest doc_id, then of the smaller text hash.

    Null doc_ids come last; null and empty texts all stay. Of repeated rows one stays.
    """
    return jaccard_join.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are one source, last in order; null and empty texts stay once. Repeated rows are documents of their own,
    and equal ones may swap their copies.
    """
    return mixing.stage(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences.

    A null text is empty and one piece. Repeated rows are documents of their own; ties in length go by doc_id and piece.
    """
    return packing.report(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing and packing have no SQL form; tests/llm holds the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
