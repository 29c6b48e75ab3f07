"""Latest row per key, with the superseded rows kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK = "__rank"
# Fixed value: the reason code of rows that a newer one replaces.
SUPERSEDED = "DUPLICATE_KEY"


def ranked_latest(
    df: DataFrame, keys: Sequence[str], newest: Sequence[str], content: Sequence[str] | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """``df`` with its rank per key: newest first, ties by ``ties``, else by the hash of ``content``.

    ``content`` should name business columns only (all columns by default), so that the same
    row wins whenever and wherever the query runs.
    """
    last = [F.col(c) for c in ties] or [F.sha2(F.to_json(F.struct(*(content or df.columns))), 256)]
    order = [F.col(c).desc() for c in newest] + last
    return df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str], **order) -> DataFrame:
    """The newest row per key.  Planned with a group limit on both sides of the shuffle."""
    return ranked_latest(df, keys, newest, **order).where(F.col(RANK) == 1).drop(RANK)


def split_latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str], **order) -> tuple[DataFrame, DataFrame]:
    """(newest row per key, the superseded rows with their reason); persist ``df`` if both are used."""
    ranked = ranked_latest(df, keys, newest, **order)
    won = F.col(RANK) == 1
    return ranked.where(won).drop(RANK), ranked.where(~won).withColumn(RANK, F.lit(SUPERSEDED)).withColumnRenamed(RANK, "reason_code")
