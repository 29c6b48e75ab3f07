"""The contract of quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.feeds import CORRUPT
from tidemark.specs import FeedSpec

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("reason_code", T.StringType()),
        T.StructField("business_key", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("rejected_at", T.TimestampType()),
        T.StructField("batch_id", T.IntegerType()),
        T.StructField("layer", T.StringType()),
    ]
)


def payload(df: DataFrame, feed: FeedSpec) -> Column:
    """The raw line where one was kept, else the raw columns as JSON (nulls left out)."""
    fields = F.to_json(F.struct(*feed.columns))
    return F.coalesce(F.col(CORRUPT), fields) if CORRUPT in df.columns else fields


def to_rejects(df: DataFrame, feed: FeedSpec, layer: str) -> DataFrame:
    """Rows with a reason_code in the contract's columns."""
    return df.select(
        F.lit(feed.entity).alias("entity"),
        "reason_code",
        F.col(feed.key).alias("business_key"),
        payload(df, feed).alias("raw_payload"),
        "source_file",
        F.current_timestamp().alias("rejected_at"),
        F.col("batch_id").cast("int").alias("batch_id"),
        F.lit(layer).alias("layer"),
    )
