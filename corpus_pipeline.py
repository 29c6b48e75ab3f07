"""A corpus pipeline of five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of
``documents``; the last returns the encoded documents.  For all stages: a null text counts as
empty, texts of any length are read whole, rows are told apart by id and text (so a row without
an id, or one that shares its id with another text, is judged by its own text), an empty table
gives an empty one, and other columns pass as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import small_batches, stash, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.near_dedup import keep_one_of_each
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import SENTENCEPIECE_MODEL
from tidemark.llm.sentencepiece_codec import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go; repeated rows go or stay together.

    Empty texts have a score of their own; without labels every score is 0.5 and all stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays.

    Null and empty texts are equal; a null id is below all others; of repeated rows one stays.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Five-word shingles, similarity 0.8 or more.  Texts without words, and rows without an id, are
    in no group and stay.
    """
    small_batches(spark)
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words is benchmark text go, with or without an id.

    Texts without words stay, and all stay where the benchmark is empty.
    """
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip, parity of every document left; empty texts have no ids.

    The workers hold less than alone: the executors' heaps have grown by then in the other stages.
    """
    small_batches(spark)
    return encode_documents(docs, SENTENCEPIECE_MODEL, batch_chars=1 << 18, held_chars=1_000_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: A trained classifier and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
