"""An independent account of the raw files, to reconcile against.

Spark only deals out the lines, so any size and any store will do; parsing is Python's own
``csv`` and ``json``, never the readers that the landing uses.  Each task returns one row.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.errors import MissingFeedError
from tidemark.sources.files import Files
from tidemark.specs import FeedSpec

ZERO = Decimal("0.00")


def exact(text: str | None, places: str = "0.01") -> Decimal | None:
    """A finite amount at two places, else None."""
    try:
        value = Decimal((text or "").strip())
    except InvalidOperation:
        return None
    return value.quantize(Decimal(places), ROUND_HALF_UP) if value.is_finite() else None


def _rows_of(line: str) -> int:
    """A JSON line is a row; an array of objects is one row for each, as Spark reads it."""
    try:
        value = json.loads(line)
    except ValueError:
        return 1
    return len(value) if isinstance(value, list) else 1


def profile_lines(lines: Iterable[str], feed: FeedSpec, amount: str | None) -> tuple[int, Decimal]:
    """(rows, sum of ``amount`` over the well-formed ones) of lines; blank ones do not count.

    A CSV header counts as a row here, and its amount is no number.
    """
    kept = [line for line in lines if line.strip()]
    if feed.format == "json":
        return sum(map(_rows_of, kept)), ZERO
    if amount is None:
        return len(kept), ZERO
    at, total = feed.columns.index(amount), ZERO
    for line in kept:
        cells = next(csv.reader([line]))
        value = exact(cells[at]) if len(cells) == len(feed.columns) else None
        total += value if value is not None else ZERO
    return len(kept), total


def source_profile(
    spark: SparkSession, batch_dir: str, feeds: Sequence[FeedSpec], amount: tuple[str, str] = ("claims", "claim_amount")
) -> dict:
    """{"rows": {entity: rows}, "control_total": sum of ``amount`` over its feed's well-formed rows}."""
    out: dict = {"rows": {}, "control_total": ZERO}
    for feed in feeds:
        path = f"{batch_dir}/{feed.file}"
        if not Files(spark).exists(path):
            raise MissingFeedError(f"{feed.entity}: {path} does not exist")
        column = amount[1] if feed.entity == amount[0] else None

        def account(parts: Iterator[pd.DataFrame], feed: FeedSpec = feed, column: str | None = column) -> Iterator[pd.DataFrame]:
            rows, total = 0, ZERO
            for part in parts:
                n, t = profile_lines(part["value"], feed, column)
                rows, total = rows + n, total + t
            yield pd.DataFrame({"rows": [rows], "total": [total]})

        found = (
            spark.read.text(path)
            .mapInPandas(account, "rows long, total decimal(38,2)")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(38,2)").alias("total"))
            .first()
        )
        header = 1 if feed.format == "csv" and found.rows else 0
        out["rows"][feed.entity] = found.rows - header
        out["control_total"] += found.total
    return out
