"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every run of ``window`` consecutive words of a benchmark item (a shorter item as a whole) is a
window to look for.  Its tokens are ordered by rarity, counted over all documents.  A document
can hold the window only where it holds its rarest token, so of each window a prefix of one
token is joined: (token, its place in the window, the window's length).  The place gives the
only possible start (positional bound), which must leave room for the window (length bound).
What is left is compared word by word with the window.

Documents are read twice, whatever the benchmark's size: once to count tokens, once to find
candidates.  Both scans carry bit filters of bounded size in place of the benchmark, which only
ever let too much pass; candidates are then joined with the windows on all their words.  Only
candidates are shuffled, never texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import matching, stash, tidy

WINDOW = 13
# What is no word: the ASCII characters other than letters and digits.  A-Z become a-z.
_FOLD = bytes(
    32 if b < 128 and not chr(b).isalnum() else (b + 32 if 65 <= b <= 90 else b) for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for value in column.cast(pa.binary()):
        yield words_of(value.as_py())


class BitFilter:
    """Keys that were put in are found; of others a few are too.  A block of 64 bits and two bits a key."""

    def __init__(self, blocks: int, rows: Iterable[tuple[int, int]] = ()):
        self.words = np.zeros(blocks, np.uint64)
        for at, bits in rows:
            self.words[at] = bits & 0xFFFFFFFFFFFFFFFF

    def place(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return (h >> 12) % len(self.words), 1 << (h & 63) | 1 << (h >> 6 & 63)

    def __contains__(self, key: bytes) -> bool:
        at, bits = self.place(key)
        return int(self.words[at]) & bits == bits


def _placed(blocks: int):
    of = BitFilter(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [of.place(key.as_py()) for key in batch.column(0)]
            at, bits = zip(*own, strict=True) if own else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64))], names=["at", "bits"]
            )

    return run


def bit_filter(keys: DataFrame, most_blocks: int) -> BitFilter:
    """The filter of a binary column.  At most ``most_blocks`` numbers come to the driver."""
    n = keys.count()
    blocks = max(64, min(most_blocks, n // 4))
    rows = keys.mapInArrow(_placed(blocks), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    return BitFilter(blocks, ((r.at, r.bits) for r in rows.toLocalIterator()))


def _windows(window: int):
    """(item_id, words) of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, words in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                starts = range(max(1, len(words) - window + 1) if words else 0)
                own = list({b" ".join(words[i : i + window]): None for i in starts})
                for part in (own[i : i + 10_000] for i in range(0, len(own), 10_000)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item_id] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item_id", "words"]
                    )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, n, token, place): every distinct token of a window at its first place."""
    for batch in batches:
        for part in (batch.slice(i, 5000) for i in range(0, len(batch), 5000)):
            rows = []
            for whole in part.column(0).to_pylist():
                words = whole.split(b" ")
                rows += [(whole, len(words), token, words.index(token)) for token in dict.fromkeys(words)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = (pa.binary(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["words", "n", "token", "place"]
            )


def _counts(vocabulary: BitFilter, most_held: int = 50_000):
    """(token, number of documents that have it) of the tokens that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        dull: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for words in _texts(batch.column(0)):
                own = set(words).difference(dull)
                no = [w for w in own if w not in counts and w not in vocabulary]
                dull.update(no)
                counts.update(own.difference(no))
                if len(dull) > most_held:
                    dull.clear()
                if len(counts) > most_held:
                    yield flush()
        yield flush()

    return tidy(run)


def _prefix(token: bytes, place: int, n: int) -> bytes:
    return b"%b %d %d" % (token, place, n)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the prefixes, and their tokens alone, which most other tokens fail by."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        keys = [_prefix(*r) for r in rows] + list({token for token, _, _ in rows})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])


def _candidates(prefixes: BitFilter, whole: BitFilter, lengths: list[int], most_held: int = 50_000):
    """Of each document its number of words and its possible windows with their starts."""
    forms = [(place, n) for n in lengths for place in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            sizes, found = [], []
            for words in _texts(batch.column(1)):
                distinct = set(words)
                for token in distinct.difference(known):
                    known[token] = tuple(f for f in forms if _prefix(token, *f) in prefixes) if token in prefixes else ()
                live = {t for t in distinct if known[t]}
                own: dict[bytes, list[int]] = {}
                dull: set[bytes] = set()
                size = len(words)
                for at in [i for i, w in enumerate(words) if w in live] if live else ():
                    for place, n in known[words[at]]:
                        start = at - place
                        if start < 0 or start + n > size:
                            continue
                        text = b" ".join(words[start : start + n])
                        if text in own:
                            own[text].append(start)
                        elif text not in dull:
                            if text in whole:
                                own[text] = [start]
                            else:
                                dull.add(text)
                sizes.append(size)
                found.append([{"words": w, "starts": s} for w, s in own.items()])
                if len(known) > most_held:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "n_words", "found"]
            )

    return tidy(run)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of words that a document's windows cover; those that touch or overlap are one."""
    for batch in batches:
        out = []
        for found in batch.column(1).to_pylist():
            merged: list[list[int]] = []
            for start, end in sorted((s, s + f["n"]) for f in found for s in f["starts"]):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            out.append(merged)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["uid", "spans"]
        )


_FOUND = pa.list_(pa.struct([("words", pa.binary()), ("starts", pa.list_(pa.int64()))]))


def _rarest(windows: DataFrame, docs: DataFrame, most_blocks: int) -> DataFrame:
    """(words, n, token, place) of each distinct window: its rarest token, ties by the token."""
    tokens = stash(
        windows.select("words").distinct().mapInArrow(_tokens, "words binary, n int, token binary, place int"), "tokens"
    )
    vocabulary = bit_filter(tokens.select("token").distinct(), most_blocks)
    counted = docs.select("text").mapInArrow(_counts(vocabulary), "token binary, n long")
    rarity = counted.groupBy("token").agg(F.sum("n").alias("docs"))
    order = F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token", "place", "n")
    return (
        tokens.join(rarity, "token", "left").groupBy("words").agg(F.min(order).alias("x")).select("words", "x.n", "x.token", "x.place")
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    most_blocks: int = 1 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans, items.

    ``spans`` are the merged ranges [start, end) of hit words, ``items`` the ids (as strings,
    sorted) of the items with an occurring window.  Null or empty texts have no words and no
    spans; texts of any length are searched whole; an item of no words is never found; an item
    without an id still marks words but is not listed; repeated documents come back repeated,
    repeated items count once.  An empty benchmark leaves every document clean, an empty table
    gives an empty result, and other columns are not looked at.  ``most_blocks`` bounds each
    bit filter (eight bytes a block) and never the result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    windows = stash(items.mapInArrow(_windows(window), "item_id string, words binary").distinct(), "windows")
    index = stash(_rarest(windows, own, most_blocks), "index")
    lengths = sorted(r.n for r in index.select("n").distinct().collect())  # at most ``window`` numbers
    prefixes = bit_filter(index.select("token", "place", "n").distinct().mapInArrow(_prefixes, "key binary"), most_blocks)
    whole = bit_filter(index.select("words"), most_blocks)

    uid = own.schema["doc_id"].dataType.simpleString()
    scanned = stash(
        own.mapInArrow(
            _candidates(prefixes, whole, lengths),
            f"doc_id {uid}, n_words long, found array<struct<words: binary, starts: array<bigint>>>",
        ).withColumn("uid", F.monotonically_increasing_id()),
        "candidates",
    )
    found = stash(
        scanned.select("uid", F.explode("found").alias("f"))
        .select("uid", "f.words", "f.starts")
        .join(index.select("words", "n"), "words")
        .select("uid", "words", "n", "starts"),
        "found",
    )
    own_starts = found.groupBy("uid").agg(F.collect_list(F.struct("n", "starts")).alias("found"))
    spans = own_starts.mapInArrow(_spans, "uid long, spans array<array<bigint>>")
    listed = (
        found.select("uid", "words")
        .join(windows.where("item_id is not null"), "words")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        scanned.select("uid", "doc_id", "n_words")
        .join(spans, "uid", "left")
        .join(listed, "uid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The verdict per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: hit words make up a twentieth of the document or more.
    """
    found = find_contamination(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_broadcast_rows: int = 500_000, **options
) -> DataFrame:
    """``docs`` without contaminated documents; all columns as they were.

    A text is judged by itself, so rows go by their texts' digests: rows that share an id but
    not a text are told apart, and a row without an id goes like any other.  Rows that stay do
    not move, unless more than ``max_broadcast_rows`` texts go.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.select(digest.alias("__key"), F.col(text_col).alias("__text"))
    bad = contamination(keyed, benchmark, id_col="__key", text_col="__text", **options).where("contaminated")
    return matching(docs, digest, bad.select(F.col("doc_id").alias("key")), keep=False, max_broadcast_rows=max_broadcast_rows)
