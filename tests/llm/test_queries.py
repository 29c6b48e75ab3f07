"""Every query of the subpackage on the smallest tables: against its SQL, or by what its contract says."""

import zlib
from pathlib import Path

import duckdb
import pytest

from tests.llm.test_pii import brute
from tidemark.llm.pii import KINDS
from tidemark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(repr, row)) for row in cursor.fetchall())
    assert sorted(tuple(repr(row[c]) for c in columns) for row in df.collect()) == want


def test_the_list_decides_pages_at_every_size(spark):
    out = QUERIES["op3_url_filter"](spark, str(DATA.parent / "sf0.01"))
    assert out.where("listed").count() > 2


def test_conversations_are_recovered(spark, duck):
    rows = QUERIES["op1_chat_format"](spark, str(DATA)).collect()
    truth = duck.execute("select conv_id, list(role order by turn, role, text) from (select distinct * from conversations) group by 1").fetchall()
    got = {r.conv_id: r.roles for r in rows}
    assert sum(got[c] == roles for c, roles in truth) >= 0.95 * len(truth)


def test_ids_decode_to_their_texts(spark, duck):
    rows = QUERIES["op2_sentencepiece"](spark, str(DATA)).collect()
    assert len(rows) == duck.execute("select count(*) from documents").fetchone()[0]
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_personal_data_against_brute_force(spark, duck):
    texts = dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    for r in QUERIES["op5_personal_data"](spark, str(DATA)).collect():
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(","))


@pytest.mark.parametrize(("name", "label", "folds", "out"), [("op6_toxicity", "toxic", 4, 2), ("op7_quality", "quality", 5, 0)])
def test_held_out_labels_are_met(spark, duck, name, label, folds, out):
    truth = dict(duck.execute(f"select doc_id, max({label}) from labels where {label} is not null group by 1").fetchall())
    rows = QUERIES[name](spark, str(DATA)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.8 * len(held)
