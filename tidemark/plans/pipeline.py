"""One batch from raw files to published tables.

land -> quarantine -> conform -> history / latest -> marts -> rules -> balances -> commit.
Everything is written as new versions; the only thing that publishes is the commit at the
end, after the rules and the balances have passed.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.errors import GateClosedError, ReconciliationError
from tidemark.logs import event
from tidemark.operators import rules as dq
from tidemark.operators.conform import TYPED, accepted_columns, judged, typed, with_references
from tidemark.operators.dedupe import RANK, SUPERSEDED, ranked_latest
from tidemark.operators.history import apply_history, newer_than
from tidemark.operators.quarantine import to_rejects
from tidemark.operators.upsert import FRESH, upsert
from tidemark.plans import marts
from tidemark.plans.reconcile import Account, reconcile
from tidemark.plans.tables import TableStore, Transaction
from tidemark.sources.feeds import classified, read_feed
from tidemark.sources.profile import source_profile
from tidemark.specs import CLAIMS, CUSTOMERS, ENTITIES, POLICIES, EntitySpec

log = logging.getLogger(__name__)
GOLD = ("dim_date", "dim_customer", "dim_policy", "fact_claims", "kpi_loss_ratio_monthly")


@dataclass
class BatchResult:
    batch_id: int
    accounts: list[Account]
    report: dict
    reconciliation: dict
    gold_rows: dict[str, int]


def _reasons(df: DataFrame) -> dict[str | None, int]:
    """Rows by reason; None: no reason.  One aggregation answers every row count of a step."""
    return {r.reason_code: r.n for r in df.groupBy("reason_code").agg(F.count("*").alias("n")).collect()}


def land(
    spark: SparkSession, raw_root: str, entity: EntitySpec, tx: Transaction, account: Account
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lands a feed: (bronze slice, rejects, the persisted rows that the rejects are read from)."""
    feed = entity.feed
    rows = classified(read_feed(spark, raw_root, feed, tx.batch), feed).persist(StorageLevel.MEMORY_AND_DISK)
    counts = _reasons(rows)
    account.landed = counts.pop(None, 0)
    account.landing_rejects = sum(counts.values())
    account.reasons |= counts
    bronze = tx.put_slice(
        f"bronze.{feed.entity}", rows.where("reason_code is null").select(*feed.columns, "batch_id", "source_file", "ingested_at")
    )
    return bronze, to_rejects(rows.where("reason_code is not null"), feed, "bronze"), rows


def conform(entity: EntitySpec, bronze: DataFrame, landing_rejects: DataFrame, tx: Transaction, account: Account) -> None:
    """Types, judges, deduplicates and merges one entity, and files its rejects."""
    tables = {r.table: tx.table(r.table) for r in entity.references}
    rows = judged(with_references(typed(bronze, entity), entity, tables), entity)
    keys = [TYPED + entity.key] + ([TYPED + entity.updated] if entity.history else [])
    good = ranked_latest(rows.where("reason_code is null"), keys, [TYPED + entity.updated], list(entity.feed.columns))
    resolved = (
        good.withColumn("reason_code", F.when(F.col(RANK) > 1, SUPERSEDED))
        .drop(RANK)
        .unionByName(rows.where("reason_code is not null"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    survivors = resolved.where("reason_code is null")
    counts = _reasons(resolved)
    kept = counts.pop(None, 0)
    account.conform_rejects = sum(counts.values())
    for code, n in counts.items():
        account.reasons[code] = account.reasons.get(code, 0) + n
    tx.put_slice(
        f"rejects.{entity.feed.entity}",
        landing_rejects.unionByName(to_rejects(resolved.where("reason_code is not null"), entity.feed, "silver")),
    )
    incoming = accepted_columns(survivors, entity)
    if entity.history:
        account.accepted = _merge_history(entity, incoming, tx)
    else:
        account.accepted = _merge_latest(entity, incoming, tx, account)
    account.stale = kept - account.accepted
    resolved.unpersist()


def _merge_history(entity: EntitySpec, incoming: DataFrame, tx: Transaction) -> int:
    """Applies what is newer than the watermark; moves the watermark to the newest applied."""
    name = entity.feed.entity
    incoming = newer_than(incoming, entity.updated, tx.base.watermarks.get(name))
    newest = F.date_format(F.max(entity.updated), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    found = incoming.agg(F.count("*").alias("n"), newest.alias("mark")).first()
    tx.put(entity.table, apply_history(tx.table(entity.table), incoming, entity.history, tx.batch))
    if found.mark:
        tx.next.watermarks[name] = found.mark
    return found.n


def _merge_latest(entity: EntitySpec, incoming: DataFrame, tx: Transaction, account: Account) -> int:
    """Merges by key; incoming rows that are not newer than the stored ones are stale."""
    merged = upsert(tx.table(entity.table), incoming, entity.key, entity.updated).persist(StorageLevel.MEMORY_AND_DISK)
    won = merged.where(FRESH)
    amounts = [a.name for a in entity.attributes if a.name == "claim_amount"]
    total = [F.coalesce(F.sum(a), F.lit(0)).cast("decimal(38,2)").alias("amount") for a in amounts]
    count = won.agg(F.count("*").alias("n"), *total).first()
    if amounts:
        offered = incoming.agg(*total).first().amount
        account.stale_amount = Decimal(offered) - Decimal(count.amount)
    tx.put(entity.table, merged.drop(FRESH))
    merged.unpersist()
    return count.n


def build_gold(tx: Transaction) -> dict[str, DataFrame]:
    """Stages the marts; the facts and ratios read the staged dimensions."""
    claims, policies = tx.table(CLAIMS.table), tx.table(POLICIES.table)
    fact = tx.put("gold.fact_claims", marts.fact_claims(claims, policies))
    return {
        "gold.dim_date": tx.put("gold.dim_date", marts.dim_date(claims, policies)),
        "gold.dim_customer": tx.put("gold.dim_customer", marts.dim_customer(tx.table(CUSTOMERS.table))),
        "gold.dim_policy": tx.put("gold.dim_policy", policies),
        "gold.fact_claims": fact,
        "gold.kpi_loss_ratio_monthly": tx.put("gold.kpi_loss_ratio_monthly", marts.kpi_monthly(fact, policies)),
    }


def run_batch(spark: SparkSession, settings: Settings, batch: int) -> BatchResult:
    """Runs a batch.  Raises before anything is published if the gate or a balance fails."""
    store = TableStore(spark, settings.lakehouse_root)
    tx = store.begin(batch)
    checks = dq.parse_rules(store.files.read_text(settings.rules_path))
    profile = source_profile(spark, f"{settings.raw_root}/batch_{batch}", [e.feed for e in ENTITIES])
    accounts = {e.feed.entity: Account(e.feed.entity, source=profile["rows"][e.feed.entity]) for e in ENTITIES}
    try:
        for entity in ENTITIES:  # in the order of their references
            account = accounts[entity.feed.entity]
            bronze, rejects, rows = land(spark, settings.raw_root, entity, tx, account)
            try:
                conform(entity, bronze, rejects, tx, account)
            finally:
                rows.unpersist()
            event(log, "entity conformed", entity=account.entity, accepted=account.accepted, rejected=account.rejected, stale=account.stale)
        gold = build_gold(tx)
        silver = {e.table: tx.table(e.table) for e in ENTITIES}
        results = dq.evaluate(silver | gold, checks)
        report = dq.report(results, batch)
        store.write_json(f"reports/dq_report_batch_{batch}.json", report)
        store.files.write_text(f"{store.root}/reports/dq_report_batch_{batch}.md", dq.report_markdown(report))
        if not report["published"]:
            path = store.write_json(f"alerts/alert_batch_{batch}.json", dq.alert(results, batch))
            raise GateClosedError(f"batch {batch}: critical rules failed, see {path}", path)
        slices = {name: spark.read.parquet(f"{store.root}/{tx.next.slices[f'rejects.{name}'][str(batch)]}") for name in accounts}
        balance = reconcile(
            list(accounts.values()), slices, silver[CLAIMS.table], gold["gold.fact_claims"], profile["control_total"], batch
        )
        store.write_json(f"reports/reconciliation_batch_{batch}.json", balance)
        if balance["status"] != "PASSED":
            failed = ", ".join(c["name"] for c in balance["checks"] if not c["passed"])
            raise ReconciliationError(f"batch {batch}: {failed}")
        rows = {name.removeprefix("gold."): df.count() for name, df in gold.items()}
        tx.commit()
    except Exception:
        tx.abort()
        raise
    event(log, "batch published", batch=batch, **rows)
    return BatchResult(batch, list(accounts.values()), report, balance, rows)


def summary(result: BatchResult) -> str:
    """The row accounts of a batch as text."""
    balance = result.reconciliation["status"]
    out = [
        f"batch {result.batch_id}: {sum(o['passed'] for o in result.report['outcomes'])} of "
        f"{len(result.report['outcomes'])} rules hold, balances {balance.lower()}",
        f"{'entity':<10}{'source':>8}{'bronze':>8}{'silver':>8}{'rejected':>10}{'stale':>7}",
    ]
    out += [f"{a.entity:<10}{a.source:>8}{a.landed:>8}{a.accepted:>8}{a.rejected:>10}{a.stale:>7}" for a in result.accounts]
    out += [f"{name:<26}{n:>8}" for name, n in result.gold_rows.items()]
    return "\n".join(out)
