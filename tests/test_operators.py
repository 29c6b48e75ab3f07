"""Operators on hand-built rows."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.exprs import age_band, conformed, date_key, fingerprint, first_failing, ratio, surrogate
from tidemark.operators.dedupe import latest, split_latest
from tidemark.operators.history import apply_history
from tidemark.operators.temporal import as_of_join, in_force_by_month
from tidemark.operators.upsert import FRESH, upsert
from tidemark.plans import marts
from tidemark.specs import HistorySpec

POLICY = HistorySpec("k", ("price", "status"), start="start", surrogate="sk")
SCHEMA = "k string, price decimal(12,2), status string, start date, updated_at timestamp"


def row(k, price, status, start, updated):
    return (k, Decimal(price), status, date.fromisoformat(start), datetime.fromisoformat(updated))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_latest_keeps_newest_and_reports_the_rest(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", "w", 1)], "k string, v string, t int")
    good, bad = split_latest(df, ["k"], ["t"])
    assert {r.v for r in good.collect()} == {"y", "w"}
    assert sorted((r.v, r.reason_code) for r in bad.collect()) == [("x", "DUPLICATE_KEY"), ("z", "DUPLICATE_KEY")]


def test_ties_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", str(i), 1) for i in range(20)], "k string, v string, t int")
    found = {latest(df.repartition(n), ["k"], ["t"]).first().v for n in (1, 3, 7)}
    assert len(found) == 1


def test_first_failing_order_and_unknown(spark):
    df = spark.createDataFrame([(1, None), (-1, "x"), (None, "x")], "n int, s string")
    codes = df.select(first_failing([(F.col("n") < 0, "NEG"), (F.col("s").isNull(), "NO_S")]).alias("c"))
    assert [r.c for r in codes.collect()] == ["NO_S", "NEG", None]


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("1e3", "decimal(14,2)", Decimal("1000.00")),
        (" 7.5 ", "decimal(14,2)", Decimal("7.50")),
        ("10.005", "decimal(14,2)", Decimal("10.01")),
        ("12,5OO", "decimal(14,2)", None),
        ("", "decimal(14,2)", None),
        ("9999999999999", "decimal(14,2)", None),
        ("2026-02-30", "date", None),
        ("2026-2-3", "date", date(2026, 2, 3)),
        ("31/01/2026", "date", None),
        ("  ada lovelace ", "title", "Ada Lovelace"),
    ],
)
def test_conformed(spark, text, kind, want):
    assert one(spark, conformed(F.lit(text), kind)) == want


def test_small_expressions(spark):
    assert one(spark, date_key(F.lit("2026-03-09").cast("date"))) == 20260309
    assert one(spark, age_band(F.lit("1996-01-02").cast("date"), F.lit("2026-01-01").cast("date"))) == "18-29"
    assert one(spark, age_band(F.lit("1996-01-01").cast("date"), F.lit("2026-01-01").cast("date"))) == "30-44"
    assert one(spark, age_band(F.lit(None).cast("date"), F.lit("2026-01-01").cast("date"))) is None
    assert one(spark, surrogate(F.lit(None).cast("string"))) is None
    assert one(spark, ratio(F.lit(1), F.lit(0), 2)) is None
    a = spark.createDataFrame([(Decimal("1.5"), None)], "x decimal(12,2), y string")
    b = spark.createDataFrame([(Decimal("1.50"), None)], "x decimal(12,2), y string")
    assert a.select(fingerprint(["x", "y"])).first() == b.select(fingerprint(["x", "y"])).first()


@pytest.fixture
def first_batch(spark):
    rows = [
        row("p1", "100", "ACTIVE", "2025-03-01", "2026-01-05 10:00:00"),
        row("p2", "200", "ACTIVE", "2025-04-01", "2026-01-06 10:00:00"),
        row("p3", "300", "ACTIVE", "2025-05-01", "2026-01-07 10:00:00"),
    ]
    return apply_history(None, spark.createDataFrame(rows, SCHEMA).withColumn("start", F.col("start")), SPEC(), 1)


def SPEC():
    return HistorySpec("k", ("price", "status", "start"), start="start", surrogate="sk")


SECOND = [
    row("p1", "110", "ACTIVE", "2025-03-01", "2026-02-05 10:00:00"),
    row("p2", "200", "ACTIVE", "2025-04-01", "2026-02-06 10:00:00"),  # touched only
    row("p3", "310", "ACTIVE", "2025-05-01", "2026-02-07 10:00:00"),
    row("p3", "310", "CANCELLED", "2025-05-01", "2026-02-09 10:00:00"),
    row("p4", "400", "ACTIVE", "2026-02-10", "2026-02-10 10:00:00"),
]


def versions(df, k):
    return df.where(F.col("k") == k).orderBy("effective_from").collect()


def test_first_versions_start_with_the_term_and_stay_open(first_batch):
    v = versions(first_batch, "p1")
    assert len(v) == 1 and v[0].effective_from == datetime(2025, 3, 1) and v[0].is_current
    assert v[0].effective_to.year == 9999


def test_changes_close_and_open(spark, first_batch):
    out = apply_history(first_batch, spark.createDataFrame(SECOND, SCHEMA), SPEC(), 2)
    old, new = versions(out, "p1")
    assert old.effective_to == new.effective_from == datetime(2026, 2, 5, 10) and not old.is_current and new.is_current
    assert (old.batch_id, new.batch_id) == (1, 2)
    assert len(versions(out, "p2")) == 1  # a touch opens nothing
    assert [v.status for v in versions(out, "p3")] == ["ACTIVE", "ACTIVE", "CANCELLED"]
    assert out.count() == 7 and out.where("is_current").groupBy("k").count().where("count > 1").count() == 0
    assert out.select("sk").distinct().count() == 7


def test_replay_changes_nothing(spark, first_batch):
    second = spark.createDataFrame(SECOND, SCHEMA)
    out = apply_history(first_batch, second, SPEC(), 2)
    again = apply_history(out, second, SPEC(), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2)), min_size=1, max_size=12), st.integers(0, 12))
def test_two_batches_equal_one(spark, changes, cut):
    rows = [row(k, str(v), "ACTIVE", "2026-01-01", f"2026-01-{i + 2:02d} 00:00:00") for i, (k, v) in enumerate(changes)]
    df = lambda part: spark.createDataFrame(part, SCHEMA)
    whole = apply_history(None, df(rows), SPEC(), 1).drop("batch_id")
    two = apply_history(apply_history(None, df(rows[:cut]), SPEC(), 1), df(rows[cut:]), SPEC(), 2).drop("batch_id")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, two.collect()))


def test_as_of_join_binds_the_version_in_force(spark, first_batch):
    out = apply_history(first_batch, spark.createDataFrame(SECOND, SCHEMA), SPEC(), 2)
    events = spark.createDataFrame([("p1", date(2026, 2, 5)), ("p1", date(2026, 2, 6)), ("p9", date(2026, 2, 6))], "k string, d date")
    joined = as_of_join(events, out, "k", F.col("e.d").cast("timestamp")).select("e.k", "e.d", "v.price").collect()
    assert {(r.k, r.d.day): r.price for r in joined} == {("p1", 5): Decimal(100), ("p1", 6): Decimal(110), ("p9", 6): None}


def test_in_force_counts_one_version_at_a_boundary(spark):
    ts = datetime
    rows = [
        ("p", 1, ts(2026, 1, 1), ts(2026, 2, 1), date(2026, 1, 1), date(2026, 12, 31)),
        ("p", 2, ts(2026, 2, 1), ts(9999, 12, 31), date(2026, 1, 1), date(2026, 12, 31)),
    ]
    v = spark.createDataFrame(rows, "k string, n int, effective_from timestamp, effective_to timestamp, s date, e date")
    months = spark.createDataFrame([(date(2026, 1, 1),), (date(2026, 2, 1),)], "month_start date")
    found = in_force_by_month(v, months, "s", "e").select("month_start", "n").collect()
    assert {(r.month_start.month, r.n) for r in found} == {(1, 1), (2, 2)}
    assert in_force_by_month(v, months.where("false"), "s", "e").count() == 0


def test_upsert_keeps_the_newer_row(spark):
    old = spark.createDataFrame([("a", 2, "old"), ("b", 1, "old")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "resent"), ("b", 2, "new"), ("c", 1, "new")], "k string, t int, v string")
    found = {r.k: (r.v, r[FRESH]) for r in upsert(old, new, "k", "t").collect()}
    assert found == {"a": ("old", False), "b": ("new", True), "c": ("new", True)}


def test_kpi_nulls(spark):
    fact = spark.createDataFrame(
        [(20260105, "X", "OPEN", Decimal("10.00"), Decimal("1.00")), (20260106, "Y", "DENIED", Decimal("5.00"), Decimal("0.00"))],
        "loss_date_key int, product_line string, claim_status string, claim_amount decimal(14,2), paid_amount decimal(14,2)",
    )
    policies = spark.createDataFrame(
        [("Y", Decimal("120.00"), "ACTIVE", date(2026, 1, 1), date(2026, 12, 31), datetime(2026, 1, 1), datetime(9999, 1, 1))],
        "product_line string, premium_annual decimal(12,2), status string, policy_start date, policy_end date, effective_from timestamp, effective_to timestamp",
    )
    x, y = marts.kpi_monthly(fact, policies).collect()
    assert (x.policies_in_force, x.claim_count, x.earned_premium, x.loss_ratio, x.claim_frequency) == (0, 1, None, None, None)
    assert (x.incurred_losses, x.avg_severity) == (Decimal("10.00"), Decimal("10.00"))
    assert (y.policies_in_force, y.claim_count, y.earned_premium, y.loss_ratio) == (1, 0, Decimal("10.00"), None)
    assert (y.incurred_losses, y.claim_frequency, y.avg_severity) == (Decimal("0.00"), 0.0, None)


def test_rows_of_equal_time_do_not_depend_on_the_input_order(spark):
    rows = [row("a", 1, s, "2026-01-01", "2026-02-01") for s in ("x", "y", "z")]
    found = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        df = spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(3)
        found.add(apply_history(None, df, POLICY, 1).where("is_current").first().status)
    assert len(found) == 1


def test_history_takes_only_what_is_newer_than_the_open_version(spark):
    make = lambda *rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    first = apply_history(None, make(("a", 1, "x", "2026-01-01", "2026-02-01")), POLICY, 1)
    late = make(("a", 2, "old", "2026-01-01", "2026-01-31"), ("a", 3, "same", "2026-01-01", "2026-02-01"), ("b", 1, "n", "2026-01-01", "2026-01-05"))
    out = apply_history(first, late, POLICY, 2).collect()
    assert sorted((r.k, r.status, r.batch_id) for r in out) == [("a", "x", 1), ("b", "n", 2)]


def test_as_of_join_against_brute_force(spark):
    """Hot keys, events at both ends of intervals, before the first, in gaps, without a key or a time."""
    t = lambda n: datetime(2026, 1, 1) + timedelta(hours=n)
    versions = [(k, v, t(a), t(b)) for k in ("hot", "b") for v, a, b in (("one", 2, 5), ("none", 5, 5), ("two", 5, 9), ("three", 11, 20))]
    versions.append((None, "nobody", t(0), t(50)))
    events = [(i, k, t(h)) for i, (k, h) in enumerate([("hot", h) for h in range(25)] * 3 + [("b", 5), ("c", 5), (None, 3)])] + [(999, "b", None)]
    out = as_of_join(
        spark.createDataFrame(events, "id int, k string, at timestamp"),
        spark.createDataFrame(versions, "k string, name string, effective_from timestamp, effective_to timestamp"),
        "k",
        F.col("e.at"),
    )
    want = [
        (i, next((v for vk, v, a, b in versions if vk == k and k is not None and at is not None and a <= at < b), None)) for i, k, at in events
    ]
    assert sorted(((r.id, r.name) for r in out.select("e.id", "v.name").collect()), key=str) == sorted(want, key=str)


def test_in_force_without_months_is_empty(spark):
    versions = spark.createDataFrame([("p", t, t, t, t) for t in [datetime(2026, 1, 1)]], "k string, effective_from timestamp, effective_to timestamp, a timestamp, b timestamp")
    months = spark.createDataFrame([], "month_start date")
    assert in_force_by_month(versions, months, "a", "b").count() == 0
