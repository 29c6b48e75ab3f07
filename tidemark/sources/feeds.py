"""Permissive landing of raw feeds, and the first quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import MissingFeedError
from tidemark.functions.exprs import blank, first_failing
from tidemark.sources.files import Files
from tidemark.specs import FeedSpec

CORRUPT = "_corrupt_record"
META = ("batch_id", "source_file", "ingested_at")


def landing_schema(feed: FeedSpec) -> T.StructType:
    """All columns as text, and where a line that does not fit goes whole."""
    return T.StructType([T.StructField(c, T.StringType()) for c in (*feed.columns, CORRUPT)])


def reader_options(feed: FeedSpec) -> dict[str, str]:
    """Nothing fails at landing: what does not fit is kept in the corrupt column."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return options | ({"header": "true", "enforceSchema": "true"} if feed.format == "csv" else {})


def feed_path(raw_root: str, feed: FeedSpec, batch: int) -> str:
    return f"{raw_root}/batch_{batch}/{feed.file}"


def read_feed(spark: SparkSession, raw_root: str, feed: FeedSpec, batch: int) -> DataFrame:
    """The feed's rows as text with batch_id, source_file and ingested_at."""
    path = feed_path(raw_root, feed, batch)
    if not Files(spark).exists(path):
        raise MissingFeedError(f"{feed.entity}: {path} does not exist")
    raw = spark.read.schema(landing_schema(feed)).options(**reader_options(feed)).format(feed.format).load(path)
    return stamped(raw, batch)


def stamped(raw: DataFrame, batch: int) -> DataFrame:
    return raw.select(
        "*",
        F.lit(batch).cast("int").alias("batch_id"),
        F.col("_metadata.file_path").alias("source_file"),
        F.current_timestamp().alias("ingested_at"),
    )


def classified(landed: DataFrame, feed: FeedSpec) -> DataFrame:
    """Adds reason_code: MALFORMED_RECORD, then NULL_KEY, else null."""
    return landed.withColumn(
        "reason_code",
        first_failing([(F.col(CORRUPT).isNotNull(), "MALFORMED_RECORD"), (blank(F.col(feed.key)), "NULL_KEY")]),
    )
