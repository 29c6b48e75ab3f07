"""Near-duplicate groups: SetSketch bands propose, a joint likelihood filters, full sets decide.

1. Every text becomes its set of word shingles, a digest of the set and a SetSketch.
   Documents with equal sets are one class; only its representative goes on.
2. Documents that share a band of registers form buckets.  Each bucket links its members
   with two hubs, its smallest id and its most central member (the one whose bands are the
   most popular), so a bucket of n proposes at most 2n pairs.  Pairs whose sketches admit
   the similarity are confirmed on the full sets.
3. What the hubs leave undecided: buckets whose other members are in several components
   still.  Only these members go on; buckets of up to three documents never do.  Those that
   such buckets connect are a family.  All members outside a family's largest component are
   compared with the whole family, in cells of bounded size, by band, likelihood and full
   set; only links that join components leave a cell.  So no pair that shares a band goes
   unexamined unless its ends are already connected.

A pair at the least similarity shares no band with a probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import setsketch as sk
from tidemark.llm.common import matching, stash, tidy
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import row_key

PERCENT = 80
#: Rows that a comparison cell holds, at most on average.
MOST_ROWS = 1_000


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, regs = [], [], []
            for text in _texts(batch.column(1)):
                found = sk.shingle_set(text, width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                regs.append(sk.registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), batch.column(2)],
                names=["doc_id", "n", "set_key", "regs", "digest"],
            )

    return tidy(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sk.shingle_set(text, width).tobytes() for text in _texts(batch.column(2))]
            own = [xxhash.xxh3_128_digest(x) == key for x, key in zip(found, batch.column(1).to_pylist(), strict=True)]
            sets = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "set"])
            yield sets.filter(pa.array(own, pa.bool_()))

    return tidy(run)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, sk.REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
            keys = sk.band_keys(_matrix(part.column(1)))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])


def _admitted(least: float):
    """Keeps the pairs whose sketches admit the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                if len(part):
                    good = sk.may_reach(
                        _matrix(part.column("u_regs")), _matrix(part.column("v_regs")),
                        part.column("u_n").to_numpy(), part.column("v_n").to_numpy(), least,
                    )
                    yield part.select(["u", "v"]).filter(pa.array(good))

    return tidy(run)


def _confirmed(percent: int):
    """Keeps the pairs whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                sk.similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent)
                for a, b in zip(batch.column("u_set"), batch.column("v_set"), strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return tidy(run)


def _cell(percent: int):
    """Links that join components, between the queries of a cell and all of its members."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        base = cell[~cell["query"]]
        asks = cell[cell["query"]] if cell["query"].any() else base[base["small"]]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        unpack = lambda frame: (
            np.frombuffer(b"".join(frame["regs"]), np.uint16).reshape(-1, sk.REGISTERS),
            [np.frombuffer(x, np.uint64) for x in frame["set"]],
            frame["n"].to_numpy(), frame["component"].to_numpy(), frame["id"].to_numpy(),
        )
        b_regs, b_sets, b_n, b_comp, b_id = unpack(base)
        a_regs, a_sets, a_n, a_comp, a_id = unpack(asks)
        b_keys, a_keys = sk.band_keys(b_regs), sk.band_keys(a_regs)
        links = []
        for i in range(len(a_id)):
            near = np.flatnonzero((b_comp != a_comp[i]) & (b_keys == a_keys[i]).any(axis=1))
            if not len(near):
                continue
            same = np.broadcast_to(a_regs[i], (len(near), sk.REGISTERS))
            near = near[sk.may_reach(same, b_regs[near], np.full(len(near), a_n[i]), b_n[near], percent / 100)]
            for j in near[np.argsort(-(b_regs[near] == a_regs[i]).sum(axis=1), kind="stable")]:
                u, v = find(a_comp[i]), find(b_comp[j])
                if u != v and sk.similar(a_sets[i], b_sets[j], percent):
                    root[max(u, v)] = min(u, v)
                    links.append((a_id[i], b_id[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    percent: int = PERCENT,
    cell_shingles: int = 1 << 18,
    max_broadcast_ids: int = 500_000,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of distinct ``width``-word
    shingles is at least ``percent`` %; component_id is the smallest id reachable.  A text of
    fewer words is one shingle.  Null, empty and blank texts have none and link with nothing
    (component_id is their own id).  A null id links with nothing and is kept.  Repeated
    rows come back repeated; different texts of one id are judged apart.  Texts of any length
    are cut into shingles whole, an empty table gives an empty result, and other columns are
    not looked at.  ``cell_shingles`` bounds what a comparison cell holds at a time; ids are
    broadcast only up to a counted ``max_broadcast_ids``, more of them take a shuffle join.
    Neither changes the result.
    """
    found = _judged(docs, id_col, text_col, width, percent, cell_shingles, max_broadcast_ids)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _judged(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, cell_shingles: int, max_broadcast_ids: int
) -> DataFrame:
    """The rows of :func:`near_dedup` with a digest of the text.  A class is known by a number of its own."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    sketched = stash(
        own.mapInArrow(_sketch(width), "doc_id long, n long, set_key binary, regs binary, digest binary"), "sketches"
    )
    classes = stash(
        sketched.where("n > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n", "regs")).alias("x"))
        .select("set_key", F.monotonically_increasing_id().alias("id"), "x.doc_id", "x.n", "x.regs"),
        "classes",
    )
    nodes = classes.select("id", "n", "regs")

    banded = nodes.select("id", "regs").mapInArrow(_bands, "key long, id long")
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stash(banded.join(buckets, "key"), "members")
    popular = members.groupBy("id").agg(F.sum("size").alias("weight"))
    # of equally popular members the largest id: the first and the central one of two members differ
    hubs = stash(
        members.join(popular, "id")
        .groupBy("key")
        .agg(F.min("id").alias("first"), F.max(F.struct("weight", "id")).alias("central"))
        .select("key", F.array_distinct(F.array("first", "central.id")).alias("hubs")),
        "hubs",
    )
    pairs = stash(
        members.join(hubs, "key")
        .select("id", F.explode("hubs").alias("hub"))
        .where("id <> hub")
        .select(F.greatest("id", "hub").alias("v"), F.least("id", "hub").alias("u"))
        .distinct(),
        "pairs",
    )

    def named(frame: DataFrame, side: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in frame.columns])

    admitted = stash(
        pairs.join(named(nodes, "u"), "u")
        .join(named(nodes, "v"), "v")
        .select("u", "v", "u_n", "v_n", "u_regs", "v_regs")
        .mapInArrow(_admitted(percent / 100), "u long, v long"),
        "admitted",
    )
    taking_part = stash(popular.select("id").join(classes.select("id", "doc_id", "set_key"), "id"), "members")
    few = taking_part.count() <= max_broadcast_ids
    sets = stash(
        own.drop("digest")
        .join(F.broadcast(taking_part) if few else taking_part, "doc_id")
        .select("id", "set_key", "text")
        .mapInArrow(_sets(width), "id long, set binary")
        .groupBy("id")
        .agg(F.max("set").alias("set")),
        "sets",
    )
    links = stash(
        admitted.join(named(sets, "u"), "u")
        .join(named(sets, "v"), "v")
        .select("u", "v", "u_set", "v_set")
        .mapInArrow(_confirmed(percent), "u long, v long"),
        "links",
    )
    others = members.join(hubs, "key").where(~F.array_contains("hubs", F.col("id"))).select("key", "id")
    joined = stash(components(links).select(F.col("node").alias("id"), "component"), "joined")
    more = _undecided(others, joined, nodes, sets, percent, cell_shingles)
    found = _merged(joined, more)
    linked = classes.select("set_key", "id", "doc_id").join(found, "id", "left")
    least = linked.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named_classes = linked.join(least, "component", "left").select(
        "set_key", F.coalesce("least", "doc_id").alias("component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        sketched.select("doc_id", "n", "set_key", "digest")
        .join(named_classes, "set_key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
            "digest",
        )
    )


def _merged(joined: DataFrame, more: DataFrame) -> DataFrame:
    """The components (id, component) after ``more`` links: only components that these join are looked at."""
    ends = more.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    alone = ends.join(joined, "id", "left_anti").select("id", F.col("id").alias("component"))
    whole = joined.unionByName(alone)
    name = lambda side: whole.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
    between = more.join(name("u"), "u").join(name("v"), "v")
    merged = components(between.select(F.col("u_component").alias("u"), F.col("v_component").alias("v")))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return whole.join(renamed, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def _undecided(others: DataFrame, joined: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Step 3: links (u, v) that join components of one family, found cell by cell.

    ``others`` are the members (key, id) of buckets that are no hubs: hubs were held against all.
    ``joined`` are the components (id, component) so far.
    """
    labelled = others.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    # written, so that the join below shuffles both sides plainly and AQE can deal out a hot bucket
    several = stash(
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first"))
        .where("low < high")
        .select("key", "first"),
        "several",
    )
    open_ = stash(labelled.join(several, "key").select("id", "component", "first").distinct(), "open")
    families = components(open_.select(F.col("id").alias("u"), F.col("first").alias("v"))).select(
        F.col("node").alias("id"), F.col("component").alias("family")
    )
    placed = stash(
        open_.select("id", "component").distinct().join(families, "id").join(nodes.select("id", "n"), "id"), "placed"
    )
    # a row weighs as many shingles as it has, and at least so many that a cell holds few rows
    weight = F.greatest("n", F.lit(max(1, limit // MOST_ROWS)))
    by_component = placed.groupBy("family", "component").agg(F.sum(weight).alias("weight"))
    mixed = (
        by_component.groupBy("family")
        .agg(
            F.count("*").alias("parts"),
            F.sum("weight").alias("all"),
            F.max(F.struct("weight", "component")).alias("largest"),
        )
        .where("parts > 1")
        .select(
            "family",
            F.ceil(F.col("all") / limit).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("largest.weight")) / limit).cast("int").alias("chunks"),
            F.col("largest.component").alias("main"),
        )
    )
    spot = F.xxhash64("id")
    rows = placed.join(mixed, "family").select(
        "id", "family", "component", "blocks", "chunks",
        (F.col("component") != F.col("main")).alias("small"),
        F.pmod(spot, "blocks").cast("int").alias("block"),
        F.pmod(spot, "chunks").cast("int").alias("chunk"),
    )
    base = rows.withColumn("query", F.lit(False)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    asks = (
        rows.where("small and blocks * chunks > 1")
        .withColumn("query", F.lit(True))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    cells = (
        base.unionByName(asks)
        .drop("blocks", "chunks")
        .join(nodes, "id")
        .join(sets, "id")
        .groupBy("family", "block", "chunk")
        .applyInPandas(_cell(percent), "u long, v long")
    )
    return stash(cells, "links")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    percent: int = PERCENT,
    cell_shingles: int = 1 << 18,
    max_broadcast_ids: int = 500_000,
) -> DataFrame:
    """``docs`` without the rows that :func:`near_dedup` does not keep; all columns as they were.

    Rows go by (id, digest): rows that share an id but not a text are told apart.  Rows that
    stay do not move, unless more than ``max_broadcast_ids`` keys go.
    """
    judged = _judged(docs, id_col, text_col, width, percent, cell_shingles, max_broadcast_ids)
    dropped = judged.where("not kept").select(row_key(F.col("doc_id"), F.hex("digest")).alias("key"))
    key = row_key(F.col(id_col).cast("long"), F.hex(_digest(text_col)))
    return matching(docs, key, dropped, keep=False, max_broadcast_rows=max_broadcast_ids)
