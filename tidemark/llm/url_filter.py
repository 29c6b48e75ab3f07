"""URL filter: host/path rules first, then a blocked Bloom filter over listed URLs.

A URL that no rule decides is probed in a Bloom filter of the list's canonical URLs (one
broadcast lookup and one mask test).  Only possible hits go on to the exact hash join against
the list, which removes the false positives.  The filter's size has a fixed bound; a list too
long for it has a filter that lets more URLs pass, never none.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import possible, shape
from tidemark.llm.common import stash

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def canonical_url(url: Column) -> Column:
    """host (no user, port 80 or 443, last dots or leading ``www.``) + path (no trailing ``/``) + query without ``utm_`` parameters.

    A null url or one without ``://`` gives the empty string.  Percent codes stay as they are.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    host = url_host(url)
    for extra in ("^.*@", ":(80|443)?$", "[.]+$", "^www[.]"):
        host = F.regexp_replace(host, extra, "")
    base = F.concat(host, F.regexp_replace(url_path(url), "/+$", ""))
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: int) -> Column:
    """The longest rule ``host/path-prefix`` that fits: its string (what=0) or verdict (what=1); else null.

    The rules become one CASE expression, longest first; meant for up to about a thousand.
    """
    out = F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit((rule, verdict)[what])).otherwise(out)
    return out


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``listed`` has a column ``url``; its rows are canonicalised and deduplicated here.  A
    rule decides if one fits (the longest; of equal rules the later one); else a listed URL is
    blocked and any other allowed.  Null urls have empty host and path, fit no rule and are
    allowed, as are urls without ``://``.  Repeated rows and null ids come back as they are, an
    empty table gives an empty result, an empty list blocks nothing, and other columns are not
    looked at.  ``max_filter_bytes`` bounds the filter's broadcast and never the result.  A hot
    URL is dealt out by AQE's skew join.
    """
    url = F.col(url_col)
    canon = stash(listed.select(canonical_url(F.col("url")).alias("canon")).where("canon <> ''").distinct(), "listed")
    host, path = url_host(url), url_path(url)
    judged = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical_url(url).alias("canon")
    ).select(
        "*",
        matching_rule(F.col("host"), F.col("path"), rules, 0).alias("rule"),
        matching_rule(F.col("host"), F.col("path"), rules, 1).alias("ruled"),
    )
    probed = possible(judged, canon, "canon", shape(canon.count(), max_filter_bytes)).withColumn(
        "maybe", F.col("maybe") & F.col("ruled").isNull()
    )
    columns = ["page_id", "host", "path", "rule", "ruled", "listed"]
    hits = probed.where("maybe").join(canon.withColumn("listed", F.lit(True)), "canon", "left").select(columns)
    passed = probed.where("not maybe").withColumn("listed", F.lit(False)).select(columns)
    hit = F.coalesce("listed", F.lit(False))
    return hits.unionByName(passed).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(hit, "block").otherwise("allow")).alias("verdict"),
        hit.alias("listed"),
    )
