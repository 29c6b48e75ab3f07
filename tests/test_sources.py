from collections import Counter
from decimal import Decimal

import pytest

from tidemark.config import load_settings
from tidemark.errors import ConfigError, MissingFeedError
from tidemark.sources.feeds import classified, read_feed
from tidemark.sources.generate import FeedMaker, generate
from tidemark.sources.generate import main as generator
from tidemark.sources.profile import source_profile
from tidemark.specs import CLAIMS, ENTITIES, FeedSpec
from tidemark.streaming.landing import stream_landing

FEED = FeedSpec("things", "things.csv", "csv", ("id", "a", "b"), "id")
LINES = FeedSpec("lines", "lines.json", "json", ("id", "a"), "id")


def put(tmp_path, name, text):
    (tmp_path / "batch_1").mkdir(exist_ok=True)
    (tmp_path / "batch_1" / name).write_text(text)
    return str(tmp_path)


def landed(spark, root, feed):
    return classified(read_feed(spark, root, feed, 1), feed).persist().collect()


def test_csv_landing(spark, tmp_path):
    root = put(tmp_path, "things.csv", 'id,a,b\n1,x,y\n2,x,y,EXTRA\n3,x\n\n" ",x,y\n,x,""\n')
    found = [(r.id, r.reason_code) for r in landed(spark, root, FEED)]
    assert found == [("1", None), ("2", "MALFORMED_RECORD"), ("3", "MALFORMED_RECORD"), (" ", "NULL_KEY"), (None, "NULL_KEY")]


def test_header_order_is_ignored(spark, tmp_path):
    root = put(tmp_path, "things.csv", "b,a,id\n1,2,3\n")
    assert landed(spark, root, FEED)[0].id == "1"


def test_json_landing(spark, tmp_path):
    root = put(tmp_path, "lines.json", '{"id": 1, "a": 12.50, "more": 1}\n{"id": 2\n\n[{"id": 3}, {"id": 4}]\n{"id": null}\n')
    rows = landed(spark, root, LINES)
    assert [(r.id, r.a, r.reason_code) for r in rows] == [
        ("1", "12.50", None), (None, None, "MALFORMED_RECORD"), ("3", None, None), ("4", None, None), (None, None, "NULL_KEY"),
    ]
    assert rows[0].batch_id == 1 and rows[0].source_file.endswith("lines.json") and rows[0].ingested_at


def test_missing_feed(spark, tmp_path):
    with pytest.raises(MissingFeedError):
        read_feed(spark, str(tmp_path), FEED, 1)
    with pytest.raises(MissingFeedError):
        source_profile(spark, str(tmp_path), [FEED])


def test_profile_counts_and_totals(spark, tmp_path):
    put(tmp_path, "customers.csv", "h\n" + ",".join("abcdefgh") + "\n" + "," * 7 + "\n")
    put(tmp_path, "policies.json", '{"policy_id": 1}\n\n{"cut\n')
    amounts = ["60.10", "40.10", "12;5", "nan"]
    rows = [f"c,p,d,d,{a},0,O,x,t" for a in amounts] + ["c,p,d,d,5.00,0,O,x,t,EXTRA"]
    put(tmp_path, "claims.csv", "h\n" + "\n".join(rows) + "\n")
    found = source_profile(spark, str(tmp_path / "batch_1"), [e.feed for e in ENTITIES])
    assert found == {"rows": {"customers": 2, "policies": 2, "claims": 5}, "control_total": Decimal("100.20")}


def test_generated_feeds_hold_the_planted_defects(feeds, spark):
    root, plans = feeds
    for entity in ENTITIES:
        name = entity.feed.entity
        codes = Counter(r.reason_code for r in landed(spark, root, entity.feed))
        assert codes.total() == plans[1].lines[name]
        want = {c: n for c, n in plans[1].planted[name].items() if c in ("MALFORMED_RECORD", "NULL_KEY")}
        assert {c: n for c, n in codes.items() if c} == want


def test_feeds_are_the_same_whenever_they_are_made(tmp_path):
    """A later batch can be made alone, and equals the one made after the others."""
    generate(str(tmp_path / "all"), seed=5, customers=60, claims=10, batches=3)
    FeedMaker(5, 60, 10).write_batch(str(tmp_path / "one"), 3)
    for feed in ("customers.csv", "policies.json", "claims.csv"):
        assert (tmp_path / "all/batch_3" / feed).read_text() == (tmp_path / "one/batch_3" / feed).read_text()
    generate(str(tmp_path / "other"), seed=6, customers=60, claims=10, batches=1)
    assert (tmp_path / "all/batch_1/claims.csv").read_text() != (tmp_path / "other/batch_1/claims.csv").read_text()


def test_generator_command_line(tmp_path, capsys):
    assert generator(["--raw-root", str(tmp_path), "--customers", "20", "--claims", "5", "--batches", "1"]) == 0
    assert "batch 1: customers 23" in capsys.readouterr().out and (tmp_path / "batch_1" / "claims.csv").exists()


def test_stream_lands_each_file_once(spark, feeds, tmp_path):
    root, plans = feeds
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second run finds nothing new
        stream_landing(spark, root, CLAIMS.feed, out, mark).awaitTermination()
    bronze, rejects = spark.read.parquet(f"{out}/bronze/claims"), spark.read.parquet(f"{out}/rejects/claims")
    assert rejects.count() == 8 and bronze.count() + rejects.count() == plans[1].lines["claims"] + plans[2].lines["claims"]
    assert {r.batch_id for r in bronze.select("batch_id").distinct().collect()} == {1, 2}


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "s.yaml"
    path.write_text("raw_root: a\nspark: {master: 'local[1]'}\n")
    monkeypatch.setenv("TIDEMARK_HOME", str(tmp_path))
    assert load_settings(str(path)).raw_root == str(tmp_path / "a") and load_settings(str(path)).master == "local[1]"
    monkeypatch.setenv("TIDEMARK_RAW_ROOT", "s3://b/raw")
    assert load_settings(str(path)).raw_root == "s3://b/raw"
    assert load_settings(str(path), raw_root="/given").raw_root == "/given"
    path.write_text("odd: 1\n")
    with pytest.raises(ConfigError):
        load_settings(str(path))
    with pytest.raises(ConfigError):
        load_settings(str(tmp_path / "none.yaml"))
