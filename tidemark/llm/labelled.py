"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, most_rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``most_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hashes of their ids are taken, so the sample does not depend
    on partitions.  Conflicting labels of one id count as 1; null labels and ids are left out.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
