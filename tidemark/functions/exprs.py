"""Column expressions that the operators share; all stay inside Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    """Whether any condition holds; an unknown one does not; none gives false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


def unusable(raw: Column, typed: Column) -> Column:
    """A required value that is missing or did not parse."""
    return raw.isNull() | typed.isNull()


def first_failing(rules: Sequence[tuple[Column, str]]) -> Column:
    """The code of the first condition that holds, else null; an unknown condition does not hold."""
    return F.coalesce(*[F.when(condition, F.lit(code)) for condition, code in rules], F.lit(None).cast("string"))


def blank(c: Column) -> Column:
    """Null or only blanks."""
    return c.isNull() | (F.trim(c) == "")


def conformed(raw: Column, kind: str) -> Column:
    """Trimmed and normalised text, or a cast that gives null where it fails."""
    text = F.trim(raw)
    plain = {"text": lambda c: c, "title": F.initcap, "lower": F.lower, "upper": F.upper}
    return plain[kind](text) if kind in plain else text.try_cast(kind)


def fingerprint(columns: Sequence[str]) -> Column:
    """Fixed value: the formula of the hash contract, which other writers of the tables share.

    SHA-256 of the columns in the given order, nulls told apart from empty text."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]), 256)


def date_key(day: Column) -> Column:
    """``yyyymmdd`` as an integer."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


# The first age of each band but the youngest, and the bands' names.
AGE_BANDS = ((60, "60+"), (45, "45-59"), (30, "30-44"), (0, "18-29"))


def age_band(born: Column, as_of: Column) -> Column:
    """Band of the full years from ``born`` to ``as_of``; null for no birth date."""
    years = F.floor(F.months_between(as_of, born) / 12)
    least = AGE_BANDS[-1][1]  # the youngest band is open below
    return F.when(years.isNotNull(), F.coalesce(*[F.when(years >= low, name) for low, name in AGE_BANDS], F.lit(least)))


def surrogate(*keys: Column) -> Column:
    """64-bit key of the values, null if the first is null."""
    return F.when(keys[0].isNotNull(), F.xxhash64(*keys))


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole, rounded; null where either is null or the whole is zero."""
    return F.round(F.try_divide(part, whole), places)
