"""Latest-wins merge of new rows into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRESH = "__fresh"


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str, updated: str) -> DataFrame:
    """All keys, each with its newest row, and FRESH: whether that row came in now.

    ``incoming`` holds one row per key.  A row that is not newer than the one stored does not
    replace it.
    """
    fresh = incoming.withColumn(FRESH, F.lit(True))
    if existing is None:
        return fresh
    both = existing.withColumn(FRESH, F.lit(False)).unionByName(fresh)
    order = Window.partitionBy(key).orderBy(F.col(updated).desc(), FRESH)
    return both.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
