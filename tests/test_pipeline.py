"""Batches from raw files to published tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.cli import batches_in, main
from tidemark.config import Settings
from tidemark.errors import BatchOrderError, GateClosedError, MissingFeedError, ReconciliationError
from tidemark.operators.quarantine import REJECT_SCHEMA
from tidemark.plans import pipeline
from tidemark.plans.tables import TableStore
from tidemark.sources.files import Files

RULES = str(Path(__file__).parent.parent / "config" / "rules.yaml")


@pytest.fixture
def place(feeds, tmp_path):
    return Settings(raw_root=feeds[0], lakehouse_root=str(tmp_path / "lake"), rules_path=RULES)


def test_two_batches_and_a_replay(spark, place, feeds):
    first = pipeline.run_batch(spark, place, 1)
    store = TableStore(spark, place.lakehouse_root)
    plans = feeds[1]
    for account in first.accounts:
        assert account.reasons == plans[1].planted[account.entity]
        assert account.accepted + account.rejected == plans[1].lines[account.entity] and account.stale == 0
    filed = store.slice("rejects.claims", 1, REJECT_SCHEMA)
    assert {(r.layer, r.n) for r in filed.groupBy("layer").agg(F.count("*").alias("n")).collect()} == {("bronze", 4), ("silver", 15)}
    assert {r.raw_payload.endswith(",left,over") for r in filed.where("reason_code = 'MALFORMED_RECORD'").collect()} == {True, False}
    assert "claim_id" not in json.loads(filed.where("reason_code = 'NULL_KEY'").first().raw_payload)

    second = pipeline.run_batch(spark, place, 2)
    policies = next(a for a in second.accounts if a.entity == "policies")
    assert (policies.accepted, policies.stale) == (plans[2].lines["policies"] - plans[2].stale - plans[2].planted["policies"].total(), plans[2].stale)
    assert plans[2].stale > 0 and plans[2].versions > 10
    assert first.reconciliation["status"] == second.reconciliation["status"] == "PASSED"
    assert len(second.reconciliation["checks"]) == 12 and len(second.report["outcomes"]) == 16
    dim, fact = store.table("gold.dim_policy"), store.table("gold.fact_claims")
    assert dim.count() == plans[1].versions + plans[2].versions
    assert dim.where("is_current").count() == dim.select("policy_id").distinct().count()
    assert fact.count() == 80 and fact.where("policy_sk is null or customer_sk is null").count() == 0
    bound = fact.join(dim, "policy_sk").where(
        "to_date(cast(loss_date_key as string), 'yyyyMMdd') < to_date(effective_from) or to_date(cast(loss_date_key as string), 'yyyyMMdd') >= effective_to"
    )
    assert bound.count() == 0
    assert fact.where("batch_id = 2").count() == plans[2].lines["claims"] - plans[2].planted["claims"].total() > 40
    assert store.table("gold.kpi_loss_ratio_monthly").count() == second.gold_rows["kpi_loss_ratio_monthly"] > 0
    assert not {"first_name", "last_name", "email", "date_of_birth"} & set(store.table("gold.dim_customer").columns)

    both = store.slices("rejects.claims", REJECT_SCHEMA)
    assert {r.batch_id: r["count"] for r in both.groupBy("batch_id").count().collect()} == {b: plans[b].planted["claims"].total() for b in (1, 2)}
    out = f"{place.lakehouse_root}/exported"
    store.export("rejects.claims", out)
    store.export("rejects.claims", out, batch=2)  # replaces the partitions of its batch, leaves the others
    assert spark.read.parquet(out).count() == both.count()
    assert {p.name for p in Path(out).glob("batch_id=*")} == {"batch_id=1", "batch_id=2"}

    before = {n: sorted(map(str, store.table(n).drop("ingested_at").collect())) for n in store.manifest().tables}
    again = pipeline.run_batch(spark, place, 2)
    after = {n: sorted(map(str, store.table(n).drop("ingested_at").collect())) for n in store.manifest().tables}
    assert before == after and [a.accepted for a in again.accounts] == [a.accepted for a in second.accounts]
    with pytest.raises(BatchOrderError):
        pipeline.run_batch(spark, place, 1)
    with pytest.raises(BatchOrderError):
        pipeline.run_batch(spark, place, 4)


def test_a_closed_gate_publishes_nothing(spark, place, tmp_path):
    strict = tmp_path / "strict.yaml"
    strict.write_text("rules:\n  - {name: low, table: silver.claims, type: range, column: claim_amount, max: 10}\n")
    store = TableStore(spark, place.lakehouse_root)
    with pytest.raises(GateClosedError) as e:
        pipeline.run_batch(spark, Settings(place.raw_root, place.lakehouse_root, str(strict)), 1)
    assert json.loads(Path(e.value.alert_path).read_text())["because"][0]["rule"] == "low"
    assert store.manifest().batches == [] and store.table("gold.fact_claims") is None and store.table("silver.claims") is None
    assert not list(Path(place.lakehouse_root).rglob("part-*"))
    assert pipeline.run_batch(spark, place, 1).report["published"]


def test_a_failed_balance_publishes_nothing(spark, place, monkeypatch):
    real = pipeline.source_profile
    monkeypatch.setattr(pipeline, "source_profile", lambda *a: (p := real(*a)) | {"control_total": p["control_total"] + 1})
    with pytest.raises(ReconciliationError, match="control_total_source"):
        pipeline.run_batch(spark, place, 1)
    assert TableStore(spark, place.lakehouse_root).manifest().batches == []


def write_raw(root, batch, customers, policies, claims):
    folder = root / f"batch_{batch}"
    folder.mkdir(parents=True)
    (folder / "customers.csv").write_text("customer_id,first_name,last_name,date_of_birth,email,state,segment,updated_at\n" + "".join(x + "\n" for x in customers))
    (folder / "policies.json").write_text("".join(json.dumps(x) + "\n" for x in policies))
    (folder / "claims.csv").write_text("claim_id,policy_id,loss_date,reported_date,claim_amount,paid_amount,claim_status,cause_of_loss,last_modified\n" + "".join(x + "\n" for x in claims))


def policy(**kw):
    return {
        "policy_id": "P1", "customer_id": "C1", "product_line": "AUTO", "premium_annual": 1200, "coverage_limit": 1, "deductible": 1,
        "status": "ACTIVE", "policy_start": "2025-06-01", "policy_end": "2026-06-01", "region": "WEST", "updated_at": "2026-01-02 00:00:00",
    } | kw


def test_cases_the_generator_does_not_make(spark, tmp_path):
    """Unknown customers, terms that end before they start, and claims older than the stored one."""
    raw = tmp_path / "raw"
    customer = "C1,a,b,1990-01-01,X@E.TEST,ca,retail,2026-01-01 00:00:00"
    late = "K1,P1,2026-02-05,2026-02-06,50.00,1.00,OPEN,FIRE,2026-02-10 00:00:00"
    early = "K1,P1,2026-02-05,2026-02-06,40.00,1.00,OPEN,FIRE,2026-02-09 00:00:00"
    write_raw(raw, 1, [customer], [policy(), policy(policy_id="P2", customer_id="C9"), policy(policy_id="P3", policy_end="2025-01-01")], [late])
    write_raw(raw, 2, [customer], [], [early])
    place = Settings(str(raw), str(tmp_path / "lake"), RULES)
    first = pipeline.run_batch(spark, place, 1)
    assert next(a for a in first.accounts if a.entity == "policies").reasons == {"UNKNOWN_CUSTOMER": 1, "INVALID_DATE": 1}
    second = pipeline.run_batch(spark, place, 2)
    claims = next(a for a in second.accounts if a.entity == "claims")
    assert (claims.accepted, claims.stale) == (0, 1) and second.reconciliation["status"] == "PASSED"
    assert TableStore(spark, place.lakehouse_root).table("gold.fact_claims").first().claim_amount == 50


def test_exit_codes(spark, feeds, tmp_path):
    given = ["--raw-root", feeds[0], "--lakehouse-root", str(tmp_path / "lake"), "--log-level", "ERROR"]
    assert main(["--batch", "1", "--rules", RULES, *given]) == 0
    assert main(["--batch", "3", "--rules", RULES, *given]) == 1
    strict = tmp_path / "strict.yaml"
    strict.write_text("rules:\n  - {name: low, table: silver.claims, type: range, column: claim_amount, max: 10}\n")
    assert main(["--batch", "2", "--rules", str(strict), *given]) == 2
    with pytest.raises(SystemExit) as e:
        main(["--batch", "none", *given])
    assert e.value.code == 64


def test_a_commit_is_refused_after_another(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "lake"))
    one, other = store.begin(1), store.begin(1)
    one.put("t", spark.range(3))
    one.commit()
    other.put("t", spark.range(5))
    with pytest.raises(BatchOrderError, match="another run"):
        other.commit()
    assert store.table("t").count() == 3


def test_batches_are_listed_in_any_store(spark, tmp_path):
    for name in ("batch_10", "batch_2", "batch_x", "other"):
        (tmp_path / name).mkdir()
    files = Files(spark)
    assert batches_in(files, str(tmp_path)) == batches_in(files, f"file://{tmp_path}") == [2, 10]
    with pytest.raises(MissingFeedError):
        batches_in(files, f"file://{tmp_path}/nowhere")


def test_caches_of_the_caller_stay(spark, place):
    held = spark.range(7).cache()
    held.count()
    pipeline.run_batch(spark, place, 1)
    assert held.storageLevel.useMemory
    held.unpersist()
