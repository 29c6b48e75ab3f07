"""Joins on time: the version in force at an event, and versions in force by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(events: DataFrame, versions: DataFrame, key: str, at: Column) -> DataFrame:
    """(e, v): each event as a struct, and the version of ``key`` with effective_from <= at < effective_to, or null.

    ``at`` is an expression over ``e``.  The versions of a key must not overlap.  Events and
    versions are sorted together by key and time, and each event takes the last version before
    it: linear however many events and versions a key has, where a join would try all pairs of
    the key.  Events without a key or a time have no version and are not sorted.
    """
    moment = versions.schema["effective_from"].dataType
    asked = events.select(F.struct("*").alias("e")).select("e", F.col(f"e.{key}").alias("k"), at.cast(moment).alias("t"))
    none = F.lit(None).cast(versions.select(F.struct("*").alias("v")).schema["v"].dataType)
    sought = asked.where("k is not null and t is not null").withColumn("v", none)
    held = versions.select(F.struct("*").alias("v")).select(
        F.lit(None).cast(asked.schema["e"].dataType).alias("e"),
        F.col(f"v.{key}").alias("k"),
        F.col("v.effective_from").alias("t"),
        "v",
    )
    # a version sorts before events of its own time, an empty one before the one that replaces it
    order = Window.partitionBy("k").orderBy("t", F.col("e").isNotNull(), "v.effective_to")
    last = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = sought.unionByName(held.where("k is not null")).withColumn("last", last).where("e is not null")
    matched = found.select("e", F.when(F.col("t") < F.col("last.effective_to"), F.col("last")).alias("v"))
    return matched.unionByName(asked.where("k is null or t is null").select("e", none.alias("v")))


def in_force_by_month(versions: DataFrame, months: DataFrame, start: str, end: str) -> DataFrame:
    """``versions`` x ``months.month_start`` where the version holds at the month's end and its
    term [start, end] overlaps the month.

    The term is exploded into its months (cut to the months asked for) and equi-joined, so
    no nested loop is needed.  At the month's end means: midnight after its last day lies in
    (effective_from, effective_to], which exactly one version of a key satisfies.
    """
    # scalar subqueries: no job runs while the plan is built; bounds that are unknown do not cut
    low = F.greatest(F.trunc(start, "month"), months.agg(F.min("month_start")).scalar())
    high = F.least(F.trunc(end, "month"), months.agg(F.max("month_start")).scalar())
    spread = versions.where(low <= high).withColumn(
        "month_start", F.explode(F.sequence(low, high, F.expr("interval 1 month")))
    )
    as_of = F.date_add(F.last_day("month_start"), 1).cast(versions.schema["effective_from"].dataType)
    return spread.join(months.select("month_start").distinct(), "month_start").where(
        (F.col("effective_from") < as_of) & (F.col("effective_to") >= as_of)
    )
