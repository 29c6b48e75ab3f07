import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import parse_record, url_key, warc_record, write_archives


SCHEMA = "page_id long, url string, html string, digest string, size int, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


def case():
    rng = random.Random(3)
    bodies = ["é" * 50, "x" * 100, "x" * 99, "<p>" * 400, "", None, "z" * 300_000]
    hosts = ["http://b.example.com/p", "https://a.example.com/q?x=1#f", "http://hot.org/same", None, "no scheme", "http://x.y/\r\n\t%"]
    rows = [(i, rng.choice(hosts), rng.choice(bodies)) for i in range(120)]
    rows += [(None, hosts[0], bodies[1]), (5, *rows[5][1:]), (200, hosts[2], "only one " * 30)]
    rng.shuffle(rows)
    return rows


def strip(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"file_bytes": 2000, "block_entries": 7, "max_broadcast_rows": 0}])
def test_round_trip_against_brute_force(spark, options):
    rows = case()
    index = write_archives(pages(spark, rows), **options)
    assert strip(index.read()) == strip(index.captures(pages(spark, rows))) == brute(rows)
    read = {(r.page_id, r.url): r.payload for r in index.read().where("record_type = 'response'").collect()}
    for i, url, html in rows:
        if i == 200:
            assert bytes(read[i, url]) == html.encode()
    assert index.entries().count() == len(rows)
    if options:
        assert index.directory.count() >= len(rows) // 7
    blocks = index.directory.orderBy("first", "last").collect()
    assert all(b.first <= b.last for b in blocks) and all(a.last <= b.first for a, b in zip(blocks, blocks[1:], strict=False))
    for url in ("http://hot.org/same", "https://a.example.com/q?x=1", "http://x.y/\r\n\t%"):
        want = sorted(i for i, u, _ in rows if u and u.split("#")[0] == url and i is not None)
        assert sorted(r["page_id"] for r in index.lookup(url) if r["page_id"] is not None) == want
    assert list(index.lookup("http://nowhere.net/")) == []


def test_archives_are_plain_gzip_warc(spark):
    index = write_archives(pages(spark, [(1, "http://a.b/c", "x" * 200), (2, "http://a.b/d", "x" * 200)]))
    files = list(Path(index.folder.removeprefix("file://"), "warc").glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 2 + len(files) and text.count(b"WARC-Type: revisit") == 1
    assert text.count(b"WARC-Type: warcinfo") == len(files)
    assert text.count(b"WARC-Refers-To-Target-URI: http://a.b/c\r\n") == text.count(b"WARC-Refers-To-Date: ") == 1


def test_empty_table(spark):
    index = write_archives(pages(spark, []))
    assert index.read().count() == 0 and list(index.lookup("http://a.b/")) == []
    assert index.captures(pages(spark, [(1, "http://a.b/", "x")])).count() == 0


def test_a_damaged_record_is_refused():
    data = warc_record(1, "http://a.b/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse_record(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError):
        parse_record(data[:-2])


def test_keys(spark):
    one = lambda u: spark.range(1).select(url_key(F.lit(u)).alias("x")).first().x
    assert one("http://WWW.Example.com/a?b#c") == "com,example,www)/a?b" and one(None) == ""


def test_lookup_searches_sorted_directories_and_scans_no_table(spark):
    ends = ["", "!", "\t", "$", "%", "&", "\n", "A", "é", "\r!", "%!", "/\t", "/!"]
    rows = [(i, f"http://h.org/{i % 4}{end}", f"{i} " * 60) for i, end in enumerate(ends * 16)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = write_archives(pages(spark, rows), block_entries=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, url, _ in rows:
        want.setdefault(url, []).append(i)
    assert list(index.lookup("http://h.org/nothing")) == []
    assert len(index._files) > 1
    files = index._files
    asked = spark.createDataFrame([(u,) for u in [*want, *want, "http://h.org/nothing", None]], "url string")
    assert sorted(r.page_id for r in index.resolve(asked).collect()) == sorted(i for i, _, _ in rows)
    some = [u for u in want if "\t" in u or "!" in u]
    got = index.captures(spark.createDataFrame([(u,) for u in some], "url string")).collect()
    assert sorted(r.page_id for r in got) == sorted(i for u in some for i in want[u])
    index.directory = None
    assert index._files is files
    for url, ids in want.items():
        assert [r["page_id"] for r in index.lookup(url)] == ids, url
    assert list(index.lookup("http://a.org/")) == list(index.lookup("http://z.org/")) == []
