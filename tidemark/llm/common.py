"""What several operators share: the shared folder, stashed tables, rows by keys, ASCII lower-casing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bloom import possible, shape

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) a temporary folder is
    made and set; a cluster without the setting is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def matching(docs: DataFrame, key: Column, keys: DataFrame, *, keep: bool, max_broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is (keep) or is not among ``keys.key``; all columns as they were.

    ``keys`` is written once and counted.  Up to ``max_broadcast_rows`` of them are broadcast.
    More are joined by a shuffle of only those rows that a Bloom filter of bounded size lets
    pass; all other rows stay where they are.  Null keys are among nothing.
    """
    known = stash(keys.select("key").where("key is not null").distinct(), "keys")
    n = known.count()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))  # no column of docs can clash
    how = "left_semi" if keep else "left_anti"
    if n <= max_broadcast_rows:
        return rows.join(F.broadcast(known), "key", how).select("row.*")
    probed = possible(rows, known, "key", shape(n))
    found = probed.where("maybe").join(known, "key", how).select("row.*")
    return found if keep else found.unionByName(probed.where("not maybe").select("row.*"))


def small_batches(spark: SparkSession, most_rows: int = 2_000) -> None:
    """From now on at most ``most_rows`` rows go to a Python worker at once in this session.

    A batch is held outside the JVM's heap and in the worker, each time with room to grow; no
    result depends on its size.  A lower setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most_rows:
        spark.conf.set(name, str(most_rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which freed memory goes back to the system: workers live on for other stages."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII (as many bytes as characters) takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
