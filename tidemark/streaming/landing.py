"""The landing step as a stream: the same contract, files taken up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.quarantine import to_rejects
from tidemark.sources.feeds import CORRUPT, classified, landing_schema, reader_options
from tidemark.specs import FeedSpec


def stream_landing(spark: SparkSession, raw_root: str, feed: FeedSpec, out_root: str, checkpoint: str) -> StreamingQuery:
    """Takes up every file not yet seen, quarantines bad lines, appends the rest, and stops.

    The batch is read from the folder's name.  Each micro-batch writes below its own number
    and overwrites it when it is run again, so a restart neither loses nor repeats rows.
    """
    raw = (
        spark.readStream.schema(landing_schema(feed))
        .options(**reader_options(feed))
        .format(feed.format)
        .load(f"{raw_root}/batch_*/{feed.file}")
    )
    batch = F.regexp_extract("_metadata.file_path", r"/batch_(\d+)/", 1).cast("int")
    rows = raw.select(
        "*", batch.alias("batch_id"), F.col("_metadata.file_path").alias("source_file"), F.current_timestamp().alias("ingested_at")
    )

    def write(part: DataFrame, number: int) -> None:
        judged = classified(part, feed).persist()  # a corrupt column alone cannot be queried from the files
        good = judged.where("reason_code is null").drop(CORRUPT, "reason_code")
        good.write.mode("overwrite").parquet(f"{out_root}/bronze/{feed.entity}/part={number}")
        bad = to_rejects(judged.where("reason_code is not null"), feed, "bronze")
        bad.write.mode("overwrite").parquet(f"{out_root}/rejects/{feed.entity}/part={number}")
        judged.unpersist()

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
