"""Every query of the catalogue against its SQL, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v.normalize()) if isinstance(v, Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == want


def test_late_rows_between_a_version_and_its_repeats_equal_sql(spark, tmp_path):
    """Few users, kinds and times: late rows before, at and after open versions and their repeats."""
    con = duckdb.connect()
    con.execute(
        f"""copy (select i as event_id, CAST(hash(i) % 40 AS BIGINT) as user_id, chr(CAST(97 + hash(i + 7000) % 2 AS INTEGER)) as event_type,
          TIMESTAMP '2024-01-08 00:00:00' + to_hours(12 * CAST(hash(i + 9000) % 32 AS INTEGER)) as ts from range(900) r(i))
          to '{tmp_path}/events.parquet'"""
    )
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cursor = con.execute(ORACLES["scd2_late_rows"])
    columns = [c[0] for c in cursor.description]
    want = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in QUERIES["scd2_late_rows"](spark, str(tmp_path)).collect()) == want
