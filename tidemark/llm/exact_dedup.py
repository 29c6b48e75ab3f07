"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's mergeable frequent-items sketch) proposes digests that may
be frequent; an exact count verifies them.  The verified winners, at most ``winners``
rows, are broadcast, so copies in huge groups are resolved map-side.  All other digests
take an ordinary shuffle.  The sketch has every digest of more than a share of 1 / ``counters``
of all rows, and at most ``winners`` digests can have a share of 1 / ``winners``, so that is the
most that a group of the rest can have; it is aggregated before the shuffle, and the join that
hands its result back to the rows is one that AQE may split.  Only digests and ids move, never
texts.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, matching, stash


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    counters: int = 8192,
    winners: int = 1024,
    min_count: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The row with the largest id of
    a group stays.  A null text counts as empty; a null id sorts below every other id; of
    repeated rows with the same id exactly one stays; an empty table gives an empty result;
    texts of any length are digested whole; other columns are not looked at.  ``counters``
    bounds the summary, ``winners`` the broadcast; neither changes the result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(ascii_lower(text), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digests",
    )
    best = F.max(F.struct("doc_id", "uid"))

    proposed = (
        digests.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {counters})").alias("top"))
        .select(F.explode("top").alias("t"))
        .where(F.col("t.count") >= min_count)
        .select(F.col("t.item").alias("text_sha256"))
    )
    heavy = stash(
        digests.join(F.broadcast(proposed), "text_sha256")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= min_count),
        "heavy",
    )
    hot = digests.join(F.broadcast(heavy), "text_sha256")
    light = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    rest = light.join(groups, "text_sha256")
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        "text_sha256",
    )


def row_key(doc_id: Column, digest: Column) -> Column:
    """What tells rows apart that share an id or a text; a null id has a key of its own."""
    return F.concat_ws("/", digest, doc_id.cast("string"))


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_broadcast_rows: int = 500_000
) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns as they were.

    Rows go by (id, digest): rows that share an id but not a text are told apart, and of
    repeated rows one stays.  Rows that stay do not move, unless more than
    ``max_broadcast_rows`` keys go; then a Bloom filter keeps most of them in place.
    """
    found = exact_dedup(docs, id_col, text_col)
    verdicts = stash(
        found.groupBy(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
        .agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        .where("not kept or n > 1"),
        "verdicts",
    )
    key = row_key(F.col(id_col), F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    out = matching(docs, key, verdicts, keep=False, max_broadcast_rows=max_broadcast_rows)
    repeated = verdicts.where("kept")
    if repeated.isEmpty():
        return out
    again = matching(docs, key, repeated, keep=True, max_broadcast_rows=max_broadcast_rows)
    one = again.select(F.struct("*").alias("row"), key.alias("key")).groupBy("key").agg(F.any_value("row").alias("row"))
    return out.unionByName(one.select("row.*"))
