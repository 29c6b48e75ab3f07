"""Types, rules and references of an entity, from its declaration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import any_of, conformed, first_failing, unusable
from tidemark.specs import EntitySpec

TYPED = "t__"
_DATES = ("date", "timestamp")


def typed(landed: DataFrame, entity: EntitySpec) -> DataFrame:
    """The raw columns and, under a prefix, their conformed forms."""
    return landed.select(
        "*", *[conformed(F.col(a.name), a.kind).alias(TYPED + a.name) for a in entity.attributes]
    )


def with_references(df: DataFrame, entity: EntitySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Adds for each reference whether its value is known: a left join to the distinct keys."""
    for i, ref in enumerate(entity.references):
        keys = (
            tables[ref.table]
            .select(F.col(ref.ref_column).alias(f"__ref{i}"))
            .where(F.col(f"__ref{i}").isNotNull())
            .distinct()
        )
        df = df.join(keys, F.col(TYPED + ref.column) == F.col(f"__ref{i}"), "left")
    return df


def judged(df: DataFrame, entity: EntitySpec) -> DataFrame:
    """Adds reason_code: the first rule that fails, in the order dates, numbers, signs, references."""
    t = lambda name: F.col(TYPED + name)
    needed = [a for a in entity.attributes if a.required]
    dates = [unusable(F.col(a.name), t(a.name)) for a in needed if a.kind in _DATES]
    if entity.period:
        dates.append(t(entity.period[1]) < t(entity.period[0]))
    numbers = [unusable(F.col(a.name), t(a.name)) for a in needed if a.kind not in _DATES]
    negative = [t(a.name) < 0 for a in entity.attributes if a.non_negative]
    rules = [(any_of(dates), "INVALID_DATE"), (any_of(numbers), "INVALID_NUMBER"), (any_of(negative), "NEGATIVE_AMOUNT")]
    rules += [(F.col(f"__ref{i}").isNull(), r.code) for i, r in enumerate(entity.references)]
    out = df.withColumn("reason_code", first_failing(rules))
    return out.drop(*[f"__ref{i}" for i in range(len(entity.references))])


def accepted_columns(df: DataFrame, entity: EntitySpec) -> DataFrame:
    """The conformed columns under their own names, and the batch."""
    return df.select(*[F.col(TYPED + a.name).alias(a.name) for a in entity.attributes], "batch_id")
