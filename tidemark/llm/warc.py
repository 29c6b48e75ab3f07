"""WARC archives with revisit records and a two-level capture index.

Pages are written as gzip members, one record each, into archive files in the shared
folder.  Payloads that occur again are written as ``revisit`` records that point at the
``response``.  The index sorts entries by reversed-host URL key into compressed blocks; a
sparse directory holds one row a block; each index file's part of it is written beside the
file.  A lookup binary-searches the key ranges of the index files (one row a file, which the
driver holds), then the directory of a file, reads one block by range, binary-searches the
block and reads one record by range.  ``lookup`` does this for one URL, ``captures`` for a
table of URLs in parallel: sorted keys find their blocks, so directories are read one after
the other, and every block is searched once, wherever a hot key's many blocks are dealt.

Files are opened through ``pyarrow.fs``, so the folder may be in any store it can reach.
Every attempt of a task writes files of its own and returns their names, so a lost
executor leaves files that nothing refers to and never half a file that something does.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path, stash
from tidemark.llm.url_filter import url_host

LEAST_PAYLOAD = 100
_NAMES = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
_ENTRY = "key string, page_id long, file string, offset long, length long"
_BLOCK = "first string, last string, file string, offset long, length long, entries long"
_RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``; the empty string for a null url, ``)`` + url without a host."""
    host = F.array_join(F.reverse(F.split(url_host(url), "[.]")), ",")
    rest = F.regexp_replace(F.regexp_replace(url, "^.*?://[^/?#]*", ""), "#.*$", "")
    return F.when(url.isNull(), F.lit("")).otherwise(F.concat(host, F.lit(")"), rest))


def _index_key(url: Column) -> Column:
    """The key as it is sorted and stored: without tabs and line ends."""
    key = url_key(url)
    for c in "%\t\n\r":
        key = F.replace(key, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return key


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def _header_safe(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def warc_info(name: str, date: str) -> bytes:
    """The uncompressed record that opens an archive file."""
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, name)}>",
        f"WARC-Filename: {name}",
        f"WARC-Date: {date}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, refers_url: str | None = None
) -> bytes:
    """One uncompressed record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Target-URI: {_header_safe(url) if url else 'about:blank'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is None:
        lines.append("X-No-Url: 1")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
        if refers_url:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_safe(refers_url)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one uncompressed record; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if not rest[len(block) :] == b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": None if "X-No-Url" in fields else fields["WARC-Target-URI"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in fields else None,
        "payload": None,
    }
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != out["payload_bytes"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
        out["payload"] = payload
    return out


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _archive_writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        entries: dict[str, list] = {k: [] for k in ("key", "page_id", "file", "offset", "length")}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, at
            if out is not None:
                out.close()
                out, at = None, 0
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(entries.values(), types, strict=True)], names=list(entries)
                )
                for v in entries.values():
                    v.clear()

        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(6)), batch.column(6).cast(pa.binary()), strict=True)
            for key, page_id, url, digest, refers_to, refers_url, html in rows:
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = _gzip(warc_info(name, date))
                    out.write(data)
                    at = len(data)
                page, first = page_id.as_py(), refers_to.as_py()
                data = _gzip(warc_record(page, url.as_py(), html.as_py() or b"", digest.as_py(), first, date, refers_url.as_py()))
                out.write(data)
                for k, v in zip(entries, (key.as_py(), page, name, at, len(data)), strict=True):
                    entries[k].append(v)
                at += len(data)
                if at >= file_bytes:
                    yield from close()
        yield from close()

    return run


def _block_writer(folder: str, block_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.idx", 0
        rows: list[tuple] = []
        blocks: list[tuple] = []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            text = "\n".join("\t".join("" if x is None else str(x) for x in row) for row in rows)
            data = zlib.compress(text.encode(), 6)
            out.write(data)
            blocks.append((rows[0][0], rows[-1][0], name, at, len(data), len(rows)))
            at += len(data)
            rows.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                if len(rows) >= block_entries:
                    flush()
        if rows:
            flush()
        if out is not None:
            out.close()
            own = "\n".join(f"{first}\t{last}\t{offset}\t{length}" for first, last, _, offset, length, _ in blocks)
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as listed:
                listed.write(zlib.compress(own.encode(), 6))
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*blocks, strict=True), types, strict=True)],
                names=["first", "last", "file", "offset", "length", "entries"],
            )

    return run


def _entries(data: bytes) -> Iterator[tuple[str, int | None, str, int, int]]:
    for line in zlib.decompress(data).decode().split("\n"):
        key, page_id, file, offset, length = line.split("\t")
        yield key, int(page_id) if page_id else None, file, int(offset), int(length)


class _Ranges:
    """Range reads of the files of one folder; neighbouring reads share one request."""

    def __init__(self, folder: str, ahead: int = 1 << 20):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.ahead, self.name, self.start, self.held, self.file = ahead, None, 0, b"", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.file, self.name, self.held = self.fs.open_input_file(f"{self.base}/{name}"), name, b""
        if not self.start <= offset <= offset + length <= self.start + len(self.held):
            self.start, self.held = offset, self.file.read_at(max(length, self.ahead), offset)
        at = offset - self.start
        return self.held[at : at + length]


def _spanning(rows: list[tuple], key: str) -> Iterator[tuple]:
    """The rows (first, last, ...) whose range holds the key; ranges are in order and share ends at most."""
    at = bisect.bisect_left(rows, key, key=lambda r: r[1])
    while at < len(rows) and rows[at][0] <= key:
        yield rows[at]
        at += 1


def _directory(ranges: _Ranges, name: str) -> list[tuple]:
    with ranges.fs.open_input_stream(f"{ranges.base}/{name}.dir", compression=None) as f:
        return [tuple(line.split("\t")) for line in zlib.decompress(f.read()).decode().split("\n")]


def _block_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield _placed(list(_entries(ranges.read(file, offset, length))))

    return run


_PLACE = {"key": pa.string(), "page_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PLACE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLACE.values(), strict=True)], names=list(_PLACE))


def _locator(folder: str, files: list[tuple[str, str, str]]):
    """The blocks (file, offset, length) that may hold each key; keys come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder, 0)
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                own = [name for _, _, name in _spanning(files, key)]
                held = {name: rows for name, rows in held.items() if name in own}  # sorted keys never come back to a file
                for name in own:
                    if name not in held:
                        held[name] = _directory(ranges, name)
                    out += [(key, name, int(offset), int(length)) for _, _, offset, length in _spanning(held[name], key)]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "file", "offset", "length"]
            )

    return run


def _searcher(folder: str):
    """The entries of the wanted keys; the rows of one block come together, and it is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, at, rows = _Ranges(folder), None, []
        for batch in batches:
            out = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, offset):
                    at, rows = (file, offset), list(_entries(ranges.read(file, offset, length)))
                i = bisect.bisect_left(rows, key, key=lambda r: r[0])
                while i < len(rows) and rows[i][0] == key:
                    out.append(rows[i])
                    i += 1
            yield _placed(out)

    return run


def _record_reader(folder: str, payloads: bool):
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                found = []
                for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    record = parse_record(zlib.decompress(ranges.read(file, offset, length), 31))
                    found.append(record if payloads else record | {"payload": None})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in found], t) for k, t in types.items()], names=list(types)
                )

    return run


@dataclass
class CaptureIndex:
    """The archives below ``folder`` and the sparse directory of their index blocks."""

    spark: SparkSession
    folder: str
    directory: DataFrame

    def entries(self) -> DataFrame:
        """Every entry of every block: key, page_id, file, offset, length."""
        return self.directory.select("file", "offset", "length").mapInArrow(_block_reader(f"{self.folder}/index"), _ENTRY)

    def read(self, payloads: bool = True) -> DataFrame:
        """Every record, by range reads in the order of each archive."""
        return self._records(self.entries(), payloads)

    def resolve(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """The entries of the captures of every distinct URL of a table: key, page_id, file, offset, length.

        Every key is searched through the file ranges, one file's directory and the blocks that
        may hold it.  A null URL stands for captures without one; unknown URLs find nothing.
        """
        keys = urls.select(_index_key(F.col(url_col)).alias("key")).distinct()
        index = f"{self.folder}/index"
        located = (
            keys.repartitionByRange("key")
            .sortWithinPartitions("key")
            .mapInArrow(_locator(index, self._files), "key string, file string, offset long, length long")
        )
        together = located.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
        return together.mapInArrow(_searcher(index), _ENTRY)

    def captures(self, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
        """The records of the captures of every distinct URL of a table, each once."""
        return self._records(self.resolve(urls, url_col), payloads)

    def _records(self, entries: DataFrame, payloads: bool) -> DataFrame:
        placed = entries.select("file", "offset", "length")
        ordered = placed.repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(_record_reader(f"{self.folder}/warc", payloads), _RECORD)

    @cached_property
    def _files(self) -> list[tuple[str, str, str]]:
        """(first, last, file) of every index file in order: a row for each task that wrote one."""
        ends = self.directory.groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        return sorted(tuple(r) for r in ends.select("first", "last", "file").collect())

    def lookup(self, url: str) -> Iterator[dict]:
        """The captures of one URL, in the order of their ids."""
        key = self.spark.range(1).select(_index_key(F.lit(url)).alias("k")).first().k
        blocks, records = _Ranges(f"{self.folder}/index", 0), _Ranges(f"{self.folder}/warc", 0)
        for _, _, name in _spanning(self._files, key):
            for _, _, offset, length in _spanning(_directory(blocks, name), key):
                rows = list(_entries(blocks.read(name, int(offset), int(length))))
                at = bisect.bisect_left(rows, key, key=lambda r: r[0])
                while at < len(rows) and rows[at][0] == key:
                    _, _, file, start, size = rows[at]
                    yield parse_record(zlib.decompress(records.read(file, start, size), 31))
                    at += 1


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    folder: str | None = None,
    least_payload: int = LEAST_PAYLOAD,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = 256 << 20,
    block_entries: int = 1000,
    max_broadcast_rows: int = 100_000,
) -> CaptureIndex:
    """Writes one record per row and the index, and returns the index.

    Of equal payloads of ``least_payload`` bytes or more the row with the smallest id is the
    response and the others revisit it.  A null payload is empty.  A row without an id is
    always a response and never referred to; rows that repeat the smallest id are responses
    as well (of their urls the smallest is named by revisits).  Repeated rows are records each.
    Null urls are indexed under the empty key; keys may hold any character.  Payloads of any
    length are one record.  An empty table writes nothing, and other columns are not looked at.
    Only ids and digests are shuffled to find equal payloads; the pages themselves move at
    most once, and not at all while the revisits are at most ``max_broadcast_rows`` (counted).
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "archive")
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    full = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).alias("size"),
        html.alias("html"),
    )
    narrow = stash(full.where("page_id is not null").select("page_id", "url", "digest", "size"), "digests")
    first = (
        narrow.where(F.col("size") >= least_payload)
        .groupBy("digest")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    )
    revisits = stash(
        narrow.drop("url").join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct(),
        "revisits",
    )
    few = revisits.count() <= max_broadcast_rows
    records = full.join(F.broadcast(revisits) if few else revisits, ["page_id", "digest"], "left").select(
        _index_key(F.col("url")).alias("key"), "page_id", "url", "digest", "refers_to", "refers_url", "html"
    )
    entries = stash(records.mapInArrow(_archive_writer(f"{folder}/warc", date, file_bytes), _ENTRY), "entries")
    directory = stash(
        entries.repartitionByRange("key", "page_id", "file", "offset")
        .sortWithinPartitions("key", "page_id", "file", "offset")
        .mapInArrow(_block_writer(f"{folder}/index", block_entries), _BLOCK),
        "directory",
    )
    return CaptureIndex(spark, folder, directory)
