"""Every operator as a query over the test tables, beside the SQL that gives the same rows.

The feeds of the pipeline do not exist there, so orders stand in for policies, line items
for claims and events for a change log; defects are derived by fixed expressions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import blank, conformed, fingerprint, first_failing, unusable
from tidemark.operators import rules as dq
from tidemark.operators.conform import TYPED, accepted_columns, judged, typed, with_references
from tidemark.operators.dedupe import latest, ranked_latest, split_latest
from tidemark.operators.history import apply_history, newer_than
from tidemark.operators.quarantine import to_rejects
from tidemark.operators.temporal import as_of_join, in_force_by_month
from tidemark.operators.upsert import FRESH, upsert
from tidemark.plans import marts
from tidemark.plans.reconcile import Account, reconcile
from tidemark.sources.feeds import CORRUPT, classified, feed_path, read_feed
from tidemark.specs import Attribute, EntitySpec, FeedSpec, HistorySpec, Reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MARK = "2024-01-16 00:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _money(c: str, kind: str = "decimal(14,2)") -> Column:
    return F.col(c).cast(kind)


# ------------------------------------------------------------------ dedupe
_LINE_KEY, _LINE_NEW, _LINE_TIES = ["l_orderkey", "l_linenumber"], ["l_shipdate"], ["l_partkey", "l_suppkey", "l_quantity"]
_LINE_COLUMNS = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity"
_RANKED = f"""SELECT {_LINE_COLUMNS}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", "))


@query(f"SELECT {_LINE_COLUMNS} FROM ({_RANKED}) WHERE n = 1")
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(_lines(spark, d), _LINE_KEY, _LINE_NEW, ties=_LINE_TIES)


@query(f"SELECT {_LINE_COLUMNS}, 'DUPLICATE_KEY' AS reason_code FROM ({_RANKED}) WHERE n > 1")
def dedupe_rejects(spark: SparkSession, d: str) -> DataFrame:
    return split_latest(_lines(spark, d), _LINE_KEY, _LINE_NEW, ties=_LINE_TIES)[1]


# ------------------------------------------------------------------ rules on derived defects
_RAW_SQL = """SELECT event_id, CASE WHEN event_id % 89 = 0 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS user_raw,
  CASE WHEN event_id % 97 = 0 THEN '2024-13-45' WHEN event_id % 83 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day_raw,
  CASE WHEN event_id % 79 = 0 THEN '12,5OO' WHEN event_id % 71 = 0 THEN '-' || CAST(event_id AS VARCHAR)
       ELSE CAST(event_id % 1000 AS VARCHAR) || '.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') END AS amount_raw
  FROM events"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    every = lambda n: e % n == 0
    text = e.cast("string")
    amount = F.concat((e % 1000).cast("string"), F.lit("."), F.lpad((e % 100).cast("string"), 2, "0"))
    return _t(spark, d, "events").select(
        "event_id",
        F.when(every(89), "  ").otherwise(F.col("user_id").cast("string")).alias("user_raw"),
        F.when(every(97), "2024-13-45").when(every(83), None).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day_raw"),
        F.when(every(79), "12,5OO").when(every(71), F.concat(F.lit("-"), text)).otherwise(amount).alias("amount_raw"),
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    typed = _raw(spark, d).select(
        "*",
        conformed(F.col("day_raw"), "date").alias("day"),
        conformed(F.col("amount_raw"), "decimal(14,2)").alias("amount"),
    )
    rules = [
        (blank(F.col("user_raw")), "NULL_KEY"),
        (unusable(F.col("day_raw"), F.col("day")), "INVALID_DATE"),
        (unusable(F.col("amount_raw"), F.col("amount")), "INVALID_NUMBER"),
        (F.col("amount") < 0, "NEGATIVE_AMOUNT"),
    ]
    return typed.withColumn("reason_code", first_failing(rules))


_JUDGED_SQL = f"""SELECT *, CASE WHEN user_raw IS NULL OR trim(user_raw) = '' THEN 'NULL_KEY' WHEN day IS NULL THEN 'INVALID_DATE'
  WHEN amount IS NULL THEN 'INVALID_NUMBER' WHEN amount < 0 THEN 'NEGATIVE_AMOUNT' END AS reason_code
  FROM (SELECT *, TRY_CAST(trim(day_raw) AS DATE) AS day, TRY_CAST(trim(amount_raw) AS DECIMAL(14,2)) AS amount FROM ({_RAW_SQL}))"""


@query(f"SELECT event_id, reason_code FROM ({_JUDGED_SQL})")
def first_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("event_id", "reason_code")


@query(f"SELECT reason_code, count(*) AS n FROM ({_JUDGED_SQL}) WHERE reason_code IS NOT NULL GROUP BY reason_code")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("reason_code is not null").groupBy("reason_code").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CAST(day AS VARCHAR) AS day FROM ({_JUDGED_SQL}) WHERE reason_code IS NULL")
def accepted_rows(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("reason_code is null").select("event_id", F.col("day").cast("string").alias("day"))


@query(f"SELECT event_id, CAST(TRY_CAST(day_raw AS DATE) AS VARCHAR) AS day FROM ({_RAW_SQL})")
def safe_cast_dates(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("event_id", conformed(F.col("day_raw"), "date").cast("string").alias("day"))


@query(f"SELECT event_id, TRY_CAST(amount_raw AS DECIMAL(14,2)) AS amount FROM ({_RAW_SQL})")
def safe_cast_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("event_id", conformed(F.col("amount_raw"), "decimal(14,2)").alias("amount"))


@query(
    """SELECT c_custkey, lower(trim(c_name)) AS low, upper(trim(c_mktsegment)) AS up,
    upper(left(lower(trim(c_mktsegment)), 1)) || substr(lower(trim(c_mktsegment)), 2) AS title FROM customer"""
)
def normalise_strings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(
        "c_custkey",
        conformed(F.col("c_name"), "lower").alias("low"),
        conformed(F.col("c_mktsegment"), "upper").alias("up"),
        conformed(F.col("c_mktsegment"), "title").alias("title"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_payload_extract(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ------------------------------------------------------------------ history
@query(
    """SELECT c_custkey, sha256(coalesce(c_name, '<null>') || '||' || coalesce(CAST(c_nationkey AS VARCHAR), '<null>')
    || '||' || coalesce(c_mktsegment, '<null>')) AS hash_diff FROM customer"""
)
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", fingerprint(["c_name", "c_nationkey", "c_mktsegment"]).alias("hash_diff"))


_HISTORY = HistorySpec("user_id", ("event_type",), updated="ts")
_VERSION = ["user_id", "event_type", "hash_diff", "effective_from", "effective_to", "is_current", "batch_id"]
_VERSIONS_SQL = """SELECT user_id, event_type, sha256(event_type) AS hash_diff, ts AS effective_from,
    coalesce(lead(ts) OVER k, TIMESTAMP '9999-12-31 00:00:00') AS effective_to, lead(ts) OVER k IS NULL AS is_current,
    {batch} AS batch_id
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM {source})
  WHERE before IS NULL OR before <> event_type WINDOW k AS (PARTITION BY user_id ORDER BY ts)"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    log = _t(spark, d, "events").select("user_id", "event_type", "ts")
    first = apply_history(None, log.where(F.col("ts") < F.lit(MARK).cast("timestamp_ntz")), _HISTORY, 1)
    return apply_history(first, log.where(F.col("ts") >= F.lit(MARK).cast("timestamp_ntz")), _HISTORY, 2)


@query(_VERSIONS_SQL.format(batch=1, source="events"))
def scd2_initial(spark: SparkSession, d: str) -> DataFrame:
    return apply_history(None, _t(spark, d, "events").select("user_id", "event_type", "ts"), _HISTORY, 1).select(*_VERSION)


@query(_VERSIONS_SQL.format(batch=f"CASE WHEN ts < TIMESTAMP '{MARK}' THEN 1 ELSE 2 END", source="events"))
def scd2_incremental(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select(*_VERSION)


@query(f"SELECT * FROM ({_VERSIONS_SQL.format(batch=1, source='events')}) WHERE is_current")
def scd2_current(spark: SparkSession, d: str) -> DataFrame:
    return scd2_initial(spark, d).where("is_current")


_OTHER = _VERSIONS_SQL.format(batch=1, source="(SELECT * FROM events WHERE event_type <> 'purchase')")


@query(
    f"""SELECT e.event_id, e.user_id, v.event_type AS state, v.effective_from FROM events e LEFT JOIN ({_OTHER}) v
    ON v.user_id = e.user_id AND e.ts >= v.effective_from AND e.ts < v.effective_to WHERE e.event_type = 'purchase'"""
)
def pit_join(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events")
    states = apply_history(None, events.where("event_type <> 'purchase'").select("user_id", "event_type", "ts"), _HISTORY, 1)
    joined = as_of_join(events.where("event_type = 'purchase'"), states, "user_id", F.col("e.ts"))
    return joined.select("e.event_id", "e.user_id", F.col("v.event_type").alias("state"), "v.effective_from")


@query(f"SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '{MARK}'")
def watermark_filter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").where(F.col("ts") > F.lit(MARK).cast("timestamp_ntz")).select("event_id", "user_id", "ts")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS watermark, count(*) AS n FROM events")
def watermark_advance(spark: SparkSession, d: str) -> DataFrame:
    newest = F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _t(spark, d, "events").agg(newest.alias("watermark"), F.count("*").alias("n"))


# ------------------------------------------------------------------ upsert and unions
_SECOND = "SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, CAST(2 AS INTEGER) AS version FROM customer WHERE c_custkey % 7 = 0"
_BOTH = f"SELECT c_custkey, c_name, c_nationkey, CAST(1 AS INTEGER) AS version FROM customer UNION ALL {_SECOND}"


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    second = base.where("c_custkey % 7 = 0").withColumn("c_name", F.upper("c_name")).withColumn("version", F.lit(2))
    return base.withColumn("version", F.lit(1)), second


@query(
    f"""SELECT c_custkey, c_name, c_nationkey, version, version = 2 AS fresh FROM (SELECT *, row_number() OVER
    (PARTITION BY c_custkey ORDER BY version DESC) AS n FROM ({_BOTH})) WHERE n = 1"""
)
def scd1_upsert(spark: SparkSession, d: str) -> DataFrame:
    existing, incoming = _customers(spark, d)
    return upsert(existing, incoming, "c_custkey", "version").withColumnRenamed(FRESH, "fresh")


@query(
    """SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier"""
)
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    suppliers = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


# ------------------------------------------------------------------ references
@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def ref_orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    users = _t(spark, d, "events").select("user_id").distinct()
    return _t(spark, d, "customer").join(users, F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY ALL")
def distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


# ------------------------------------------------------------------ marts
_CALENDAR_SQL = """SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS VARCHAR) AS calendar_date,
    CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month,
    monthname(day) AS month_name, strftime(date_trunc('month', day), '%Y-%m-%d') AS month_start,
    CAST(dayofweek(day) + 1 AS INTEGER) AS day_of_week, dayofweek(day) IN (0, 6) AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
        FROM orders)"""


@query(_CALENDAR_SQL)
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    days = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    found = marts.calendar(days)
    return found.withColumns({c: F.col(c).cast("string") for c in ("calendar_date", "month_start")})


@query("SELECT CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS low, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS high FROM lineitem")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return _t(spark, d, "lineitem").agg(F.min(day).cast("string").alias("low"), F.max(day).cast("string").alias("high"))


@query(
    """SELECT customer_id, sha256(email) AS email_sha256, year(born) AS birth_year,
    CASE WHEN age < 30 THEN '18-29' WHEN age < 45 THEN '30-44' WHEN age < 60 THEN '45-59' ELSE '60+' END AS age_band, segment
    FROM (SELECT *, datesub('year', born, DATE '2026-01-01') AS age FROM (SELECT c_custkey AS customer_id, c_name AS email,
      CAST(DATE '1950-01-15' + CAST(c_custkey * 37 % 19000 AS INTEGER) AS DATE) AS born, c_mktsegment AS segment FROM customer))"""
)
def dim_customer_masked(spark: SparkSession, d: str) -> DataFrame:
    born = F.date_add(F.lit("1950-01-15").cast("date"), (F.col("c_custkey") * 37 % 19000).cast("int"))
    people = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("email"),
        born.alias("date_of_birth"),
        F.lit(None).cast("string").alias("state"),
        F.col("c_mktsegment").alias("segment"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return marts.dim_customer(people).select("customer_id", "email_sha256", "birth_year", "age_band", "segment")


def _policies(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate")
    return _t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("product_line"),
        _money("o_totalprice", "decimal(12,2)").alias("premium_annual"),
        F.when(F.col("o_orderpriority") == "5-LOW", "CANCELLED").otherwise("ACTIVE").alias("status"),
        start.alias("effective_from"),
        (start + F.expr("interval 365 days")).alias("effective_to"),
        start.cast("date").alias("policy_start"),
        F.date_add(start.cast("date"), 365).alias("policy_end"),
    )


def _facts(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return _t(spark, d, "lineitem").select(
        (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + F.dayofmonth("l_shipdate")).alias("loss_date_key"),
        F.when(flag == "A", "1-URGENT").when(flag == "R", "5-LOW").otherwise("3-MEDIUM").alias("product_line"),
        F.when(F.col("l_linenumber") == 1, "DENIED").otherwise("OPEN").alias("claim_status"),
        _money("l_extendedprice").alias("claim_amount"),
        _money("l_quantity").alias("paid_amount"),
    )


_POLICIES_SQL = """SELECT o_orderpriority AS product_line, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS HUGEINT) AS cents,
    o_orderdate AS effective_from, o_orderdate + INTERVAL 365 DAY AS effective_to,
    CAST(o_orderdate AS DATE) AS policy_start, CAST(o_orderdate AS DATE) + 365 AS policy_end
  FROM orders WHERE o_orderpriority <> '5-LOW'"""
_IN_FORCE_SQL = f"""SELECT m.month_start, p.product_line, count(*) AS policies_in_force, sum(p.cents) AS cents
  FROM (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start FROM lineitem) m
  JOIN ({_POLICIES_SQL}) p ON p.effective_from < m.month_start + INTERVAL 1 MONTH
    AND p.effective_to >= m.month_start + INTERVAL 1 MONTH
    AND p.policy_start < m.month_start + INTERVAL 1 MONTH AND p.policy_end >= m.month_start
  GROUP BY m.month_start, p.product_line"""


@query(
    f"""SELECT CAST(month_start AS VARCHAR) AS month_start, product_line, policies_in_force,
    CAST(cents AS DECIMAL(38,0)) AS premium_cents FROM ({_IN_FORCE_SQL})"""
)
def in_force_monthly(spark: SparkSession, d: str) -> DataFrame:
    months = _facts(spark, d).select(marts.month_of("loss_date_key").alias("month_start")).distinct()
    active = _policies(spark, d).where("status = 'ACTIVE'")
    return (
        in_force_by_month(active, months, "policy_start", "policy_end")
        .groupBy(F.col("month_start").cast("string").alias("month_start"), "product_line")
        .agg(F.count("*").alias("policies_in_force"), (F.sum("premium_annual") * 100).cast("decimal(38,0)").alias("premium_cents"))
    )


@query(
    f"""WITH losses AS (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
        CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'R' THEN '5-LOW' ELSE '3-MEDIUM' END AS product_line,
        count(*) AS claim_count, sum(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS HUGEINT)) AS incurred,
        sum(CAST(CAST(l_quantity AS DECIMAL(14,2)) * 100 AS HUGEINT)) AS paid
      FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL),
    exposure AS ({_IN_FORCE_SQL})
    SELECT CAST(coalesce(e.month_start, l.month_start) AS VARCHAR) AS month_start,
      coalesce(e.product_line, l.product_line) AS product_line, coalesce(policies_in_force, 0) AS policies_in_force,
      coalesce(claim_count, 0) AS claim_count,
      CAST(CAST((2 * cents + 12) // 24 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS earned_premium,
      CAST(CAST(coalesce(incurred, 0) AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS incurred_losses,
      CAST(CAST(coalesce(paid, 0) AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS paid_losses,
      round(CAST(incurred AS DOUBLE) / nullif(CAST(cents AS DOUBLE) / 12, 0), 4) AS loss_ratio,
      round(CASE WHEN e.month_start IS NULL THEN NULL ELSE CAST(coalesce(claim_count, 0) AS DOUBLE) / policies_in_force END, 4)
        AS claim_frequency,
      CAST(CAST((2 * incurred + claim_count) // (2 * claim_count) AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS avg_severity
    FROM exposure e FULL JOIN losses l ON l.month_start = e.month_start AND l.product_line = e.product_line"""
)
def kpi_monthly(spark: SparkSession, d: str) -> DataFrame:
    found = marts.kpi_monthly(_facts(spark, d), _policies(spark, d))
    return found.withColumn("month_start", F.col("month_start").cast("string"))


# ------------------------------------------------------------------ rules
_RULES = """
rules:
  - {name: part_not_null, table: lineitem, type: not_null, columns: [l_partkey, l_suppkey]}
  - {name: line_unique, table: lineitem, type: unique, columns: [l_orderkey, l_linenumber], severity: warning}
  - {name: discount_range, table: lineitem, type: range, column: l_discount, min: 0, max: 0.08, severity: warning}
  - {name: flag_accepted, table: lineitem, type: accepted_values, column: l_returnflag, values: [A, N], where: "l_linenumber = 1"}
  - {name: order_resolves, table: lineitem, type: referential, column: l_orderkey, ref_table: orders, ref_column: o_orderkey}
  - {name: customer_seen, table: customer, type: referential, column: c_custkey, ref_table: events, ref_column: user_id, max_failure_pct: 95}
"""
_FLAGS = "FROM lineitem WHERE l_linenumber = 1"
_RULE_SQL = {
    "part_not_null": ("lineitem", "critical", "(SELECT count(*) FROM lineitem)", "(SELECT count(*) FROM lineitem WHERE l_partkey IS NULL OR l_suppkey IS NULL)", 0),
    "line_unique": ("lineitem", "warning", "(SELECT count(*) FROM lineitem)", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))", 0),
    "discount_range": ("lineitem", "warning", "(SELECT count(*) FROM lineitem)", "(SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08)", 0),
    "flag_accepted": ("lineitem", "critical", f"(SELECT count(*) {_FLAGS})", f"(SELECT count(*) {_FLAGS} AND l_returnflag NOT IN ('A', 'N'))", 0),
    "order_resolves": ("lineitem", "critical", "(SELECT count(*) FROM lineitem)", "(SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))", 0),
    "customer_seen": ("customer", "critical", "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey))", 95),
}


def _rule_sql(name: str) -> str:
    table, severity, total, failed, tolerated = _RULE_SQL[name]
    return (
        f"SELECT '{name}' AS rule, '{table}' AS tbl, '{severity}' AS severity, CAST(total AS BIGINT) AS total_rows, "
        f"CAST(failed AS BIGINT) AS failed_rows, coalesce(100.0 * failed / nullif(total, 0), 0) <= {tolerated} AS passed "
        f"FROM (SELECT {total} AS total, {failed} AS failed)"
    )


def _results(spark: SparkSession, d: str, names: set[str] | None = None) -> DataFrame:
    rules = [r for r in dq.parse_rules(_RULES) if names is None or r.name in names]
    tables = {t: _t(spark, d, t) for t in ("lineitem", "orders", "customer", "events")}
    rows = [(o.rule.name, o.rule.table, o.rule.severity, o.rows, o.failing, o.passed) for o in dq.evaluate(tables, rules)]
    return spark.createDataFrame(rows, "rule string, tbl string, severity string, total_rows long, failed_rows long, passed boolean")


def _rule_query(name: str, rule: str) -> None:
    QUERIES[name] = lambda spark, d: _results(spark, d, {rule})
    ORACLES[name] = _rule_sql(rule)


for _name, _rule_name in (
    ("dq_not_null", "part_not_null"),
    ("dq_unique", "line_unique"),
    ("dq_range", "discount_range"),
    ("dq_accepted", "flag_accepted"),
    ("dq_referential", "customer_seen"),
):
    _rule_query(_name, _rule_name)


@query(" UNION ALL ".join(map(_rule_sql, _RULE_SQL)))
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


# ------------------------------------------------------------------ balances
@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY l_returnflag")
def control_totals(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum(_money("l_extendedprice")).cast("decimal(38,2)")
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), total.alias("total"))


@query(
    f"""WITH r AS (SELECT *, TRY_CAST(amount_raw AS DECIMAL(38,2)) AS a FROM ({_JUDGED_SQL})),
    t AS (SELECT count(*) AS source, count(*) FILTER (reason_code = 'NULL_KEY') AS at_landing,
      count(*) FILTER (reason_code IS NOT NULL) AS rejected, count(*) FILTER (reason_code IS NULL) AS accepted,
      CAST(sum(a) AS DECIMAL(38,2)) AS total, CAST(sum(a) FILTER (reason_code IS NULL) AS DECIMAL(38,2)) AS good FROM r)
    SELECT name, 'claims' AS entity, value AS expected, value AS actual, true AS passed FROM (
      SELECT 'source_eq_bronze_plus_rejects' AS name, CAST(source AS VARCHAR) AS value FROM t
      UNION ALL SELECT 'bronze_eq_silver_plus_rejects_plus_stale', CAST(source - at_landing AS VARCHAR) FROM t
      UNION ALL SELECT 'rejects_area_accounts_for_all_rejects', CAST(rejected AS VARCHAR) FROM t
      UNION ALL SELECT 'silver_batch_rows_landed_in_fact', CAST(accepted AS VARCHAR) FROM t
      UNION ALL SELECT 'control_total_silver_eq_fact', CAST(good AS VARCHAR) FROM t
      UNION ALL SELECT 'control_total_source_eq_accepted_plus_rejected', CAST(total AS VARCHAR) FROM t)"""
)
def recon_checks(spark: SparkSession, d: str) -> DataFrame:
    """The balances of a batch whose rows are the events with derived defects."""
    rows = _judged(spark, d)
    counts = {r.reason_code: r.n for r in rows.groupBy("reason_code").agg(F.count("*").alias("n")).collect()}
    accepted, at_landing = counts.pop(None, 0), counts.pop("NULL_KEY", 0)
    rejected = sum(counts.values())
    account = Account("claims", accepted + at_landing + rejected, accepted + rejected, accepted, 0, at_landing, rejected)
    total = rows.agg(F.sum(F.col("amount_raw").try_cast("decimal(38,2)")).alias("t")).first().t
    filed = rows.where("reason_code is not null").select("reason_code", F.to_json(F.struct(F.col("amount_raw").alias("claim_amount"))).alias("raw_payload"))
    good = rows.where("reason_code is null").select(F.col("amount").alias("claim_amount"), F.lit(1).alias("batch_id"))
    checks = reconcile([account], {"claims": filed}, good, good, total, 1)["checks"]
    return spark.createDataFrame([tuple(c.values()) for c in checks], "name string, entity string, expected string, actual string, passed boolean")


# ------------------------------------------------------------------ a declared entity, from feed to fact
_ORDERS = EntitySpec(
    FeedSpec("orders", "orders.json", "json", ("order_id", "customer_id", "amount", "opened", "closed", "state", "updated"), "order_id"),
    (
        Attribute("order_id"), Attribute("customer_id"), Attribute("amount", "decimal(12,2)", required=True, non_negative=True),
        Attribute("opened", "date", required=True), Attribute("closed", "date", required=True), Attribute("state", "title"),
        Attribute("updated", "timestamp", required=True),
    ),
    updated="updated",
    table="silver.orders",
    period=("opened", "closed"),
    references=(Reference("customer_id", "silver.customers", "customer_id", "UNKNOWN_CUSTOMER"),),
)
_FEED_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN '  ' ELSE CAST(o_orderkey AS VARCHAR) END AS order_id,
  CASE WHEN o_orderkey % 67 = 0 THEN 'C' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN o_orderkey % 61 = 0 THEN 'n/a' WHEN o_orderkey % 59 = 0 THEN '-1.50' ELSE CAST(o_custkey AS VARCHAR) || '.25' END AS amount,
  CASE WHEN o_orderkey % 53 = 0 THEN '2024-13-45' WHEN o_orderkey % 47 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS opened,
  strftime(o_orderdate + INTERVAL (CASE WHEN o_orderkey % 43 = 0 THEN -5 ELSE 30 END) DAY, '%Y-%m-%d') AS closed,
  ' oPEN ' AS state, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated FROM orders"""
_TYPED_SQL = f"""SELECT *, TRY_CAST(amount AS DECIMAL(12,2)) AS t_amount, TRY_CAST(opened AS DATE) AS t_opened,
  TRY_CAST(closed AS DATE) AS t_closed FROM ({_FEED_SQL})"""
_REASONS_SQL = f"""SELECT f.*, CASE WHEN t_opened IS NULL OR t_closed IS NULL OR t_closed < t_opened THEN 'INVALID_DATE'
    WHEN t_amount IS NULL THEN 'INVALID_NUMBER' WHEN t_amount < 0 THEN 'NEGATIVE_AMOUNT'
    WHEN c.c_custkey IS NULL THEN 'UNKNOWN_CUSTOMER' END AS reason_code
  FROM ({_TYPED_SQL}) f LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = f.customer_id"""


def _feed(spark: SparkSession, d: str) -> DataFrame:
    key, day, cust = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_custkey").cast("string")
    every = lambda n: key % n == 0
    return _t(spark, d, "orders").select(
        "o_orderkey",
        F.when(every(101), "  ").otherwise(key.cast("string")).alias("order_id"),
        F.when(every(67), F.concat(F.lit("C"), cust)).otherwise(cust).alias("customer_id"),
        F.when(every(61), "n/a").when(every(59), "-1.50").otherwise(F.concat(cust, F.lit(".25"))).alias("amount"),
        F.when(every(53), "2024-13-45").when(every(47), None).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("opened"),
        F.date_add(day.cast("date"), F.when(every(43), -5).otherwise(30)).cast("string").alias("closed"),
        F.lit(" oPEN ").alias("state"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("updated"),
        F.lit(1).alias("batch_id"),
        F.lit("orders.json").alias("source_file"),
    )


def _conformed(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return judged(with_references(typed(_feed(spark, d), _ORDERS), _ORDERS, {"silver.customers": known}), _ORDERS)


@query(
    f"""SELECT order_id, trim(customer_id) AS customer, t_amount, CAST(t_opened AS VARCHAR) AS t_opened,
    CAST(t_closed AS VARCHAR) AS t_closed, 'Open' AS t_state, updated AS t_updated FROM ({_TYPED_SQL})"""
)
def conform_types(spark: SparkSession, d: str) -> DataFrame:
    t = lambda c: F.col(TYPED + c)
    return typed(_feed(spark, d), _ORDERS).select(
        "order_id",
        t("customer_id").alias("customer"),
        t("amount").alias("t_amount"),
        t("opened").cast("string").alias("t_opened"),
        t("closed").cast("string").alias("t_closed"),
        t("state").alias("t_state"),
        F.date_format(t("updated"), "yyyy-MM-dd HH:mm:ss").alias("t_updated"),
    )


@query(f"SELECT order_id, customer_id, updated, reason_code FROM ({_REASONS_SQL})")
def conform_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _conformed(spark, d).select("order_id", "customer_id", "updated", "reason_code")


@query(
    f"""SELECT trim(order_id) AS order_id, customer_id, t_amount AS amount, CAST(t_opened AS VARCHAR) AS opened,
    CAST(1 AS INTEGER) AS batch_id FROM ({_REASONS_SQL}) WHERE reason_code IS NULL"""
)
def conform_accepted(spark: SparkSession, d: str) -> DataFrame:
    good = accepted_columns(_conformed(spark, d).where("reason_code is null"), _ORDERS)
    return good.select("order_id", "customer_id", "amount", F.col("opened").cast("string").alias("opened"), "batch_id")


@query(
    f"""SELECT 'orders' AS entity, reason_code, order_id AS business_key, 'silver' AS layer, CAST(1 AS INTEGER) AS batch_id,
    'orders.json' AS source_file, amount, opened, closed FROM ({_REASONS_SQL}) WHERE reason_code IS NOT NULL"""
)
def reject_contract(spark: SparkSession, d: str) -> DataFrame:
    filed = to_rejects(_conformed(spark, d).where("reason_code is not null"), _ORDERS.feed, "silver")
    within = [F.get_json_object("raw_payload", f"$.{c}").alias(c) for c in ("amount", "opened", "closed")]
    return filed.select("entity", "reason_code", "business_key", "layer", "batch_id", "source_file", *within)


@query(
    f"""SELECT f.order_id, c.c_custkey IS NOT NULL AS known FROM ({_FEED_SQL}) f
    LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = f.customer_id"""
)
def ref_check_left(spark: SparkSession, d: str) -> DataFrame:
    known = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    twice = {"silver.customers": known.unionByName(known)}  # several versions of a key match once
    found = with_references(typed(_feed(spark, d), _ORDERS), _ORDERS, twice)
    return found.select("order_id", F.col("__ref0").isNotNull().alias("known"))


@query(
    f"""SELECT reason_code, count(*) AS n, count(order_id) AS n_keys, count(*) AS n_files, CAST(1 AS INTEGER) AS batch_id,
      max(len(line)) AS longest
    FROM (SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE order_id END AS order_id,
            CASE WHEN o_orderkey % 37 = 0 THEN 'MALFORMED_RECORD' WHEN trim(order_id) = '' THEN 'NULL_KEY' END AS reason_code,
            CASE WHEN o_orderkey % 37 = 0 THEN '{{"order_id":"' || order_id || '"' END AS line FROM ({_FEED_SQL}))
    GROUP BY reason_code"""
)
def landing_json(spark: SparkSession, d: str) -> DataFrame:
    """A feed written as lines, some cut off, and landed again: reasons, stamps and kept lines."""
    whole = F.to_json(F.struct(*_ORDERS.feed.columns))
    cut = F.concat(F.lit('{"order_id":"'), "order_id", F.lit('"'))
    lines = _feed(spark, d).select(F.when(F.col("o_orderkey") % 37 == 0, cut).otherwise(whole).alias("value"))
    root = _scratch(spark)
    lines.write.text(feed_path(root, _ORDERS.feed, 1))
    landed = classified(read_feed(spark, root, _ORDERS.feed, 1), _ORDERS.feed)
    return landed.groupBy("reason_code", "batch_id").agg(
        F.count("*").alias("n"),
        F.count("order_id").alias("n_keys"),
        F.count_if(F.col("source_file").contains(_ORDERS.feed.file) & F.col("ingested_at").isNotNull()).alias("n_files"),
        F.max(F.length(CORRUPT)).cast("long").alias("longest"),
    )


def _scratch(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share; without one, a temporary folder of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/landing-{uuid.uuid4().hex}"


@query(
    f"""SELECT order_id, amount, updated, fresh FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated DESC, fresh) AS n
    FROM (SELECT order_id, t_amount AS amount, updated, false AS fresh FROM ({_REASONS_SQL}) WHERE reason_code IS NULL AND o_orderkey % 101 <> 0
      UNION ALL SELECT order_id, t_amount + 1, strftime(CAST(updated AS TIMESTAMP) + INTERVAL (o_orderkey % 3 - 1) DAY, '%Y-%m-%d %H:%M:%S'), true
      FROM ({_REASONS_SQL}) WHERE reason_code IS NULL AND o_orderkey % 101 <> 0 AND o_orderkey % 7 = 0)) WHERE n = 1"""
)
def upsert_claims(spark: SparkSession, d: str) -> DataFrame:
    """A second batch with rows that are older than, as old as and newer than the stored ones."""
    stored = accepted_columns(_conformed(spark, d).where("reason_code is null and trim(order_id) <> ''"), _ORDERS)
    key = F.col("order_id").cast("long")
    shift = F.make_dt_interval((key % 3 - 1).cast("int"))
    incoming = stored.where(key % 7 == 0).withColumns(
        {"amount": (F.col("amount") + 1).cast("decimal(12,2)"), "updated": F.col("updated") + shift}
    )
    merged = upsert(stored, incoming, "order_id", "updated")
    return merged.select("order_id", "amount", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"), F.col(FRESH).alias("fresh"))


_LATE = f"""SELECT user_id, event_type, ts, 1 AS batch FROM events WHERE ts < TIMESTAMP '{MARK}'
  UNION ALL SELECT user_id, event_type, ts, 2 FROM events WHERE ts >= TIMESTAMP '{MARK}'
  UNION ALL SELECT user_id, 'late', ts - INTERVAL 3 DAY, 2 FROM events WHERE event_id % 5 = 0"""


@query(
    f"""WITH log AS ({_LATE}),
    opened AS (SELECT user_id, max(ts) AS at FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, sha256(event_type)) AS before
        FROM log WHERE batch = 1) WHERE before IS NULL OR before <> event_type GROUP BY user_id),
    counted AS (SELECT log.* FROM log LEFT JOIN opened o ON o.user_id = log.user_id WHERE batch = 1 OR o.at IS NULL OR log.ts > o.at),
    changed AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, batch, sha256(event_type)) AS before FROM counted)
      WHERE before IS NULL OR before <> event_type)
    SELECT user_id, event_type, sha256(event_type) AS hash_diff, ts AS effective_from,
      coalesce(lead(ts) OVER k, TIMESTAMP '9999-12-31 00:00:00') AS effective_to, lead(ts) OVER k IS NULL AS is_current,
      CAST(batch AS INTEGER) AS batch_id
    FROM changed WINDOW k AS (PARTITION BY user_id ORDER BY ts, batch, sha256(event_type))"""
)
def scd2_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """A second batch that also holds late rows: the guard drops what is older than the open versions.

    Late rows that are newer than these, but older than a repeat of them, end and reopen them.
    """
    events = _t(spark, d, "events")
    log = events.select("user_id", "event_type", "ts")
    mark = F.lit(MARK).cast("timestamp_ntz")
    sent = log.where(F.col("ts") < mark)
    first = apply_history(None, sent, _HISTORY, 1)
    late = events.where("event_id % 5 = 0").select("user_id", F.lit("late").alias("event_type"), (F.col("ts") - F.expr("interval 3 days")).alias("ts"))
    second = log.where(F.col("ts") >= mark).unionByName(late)
    return apply_history(first, second, _HISTORY, 2, seen=sent.withColumn("batch_id", F.lit(1))).select(*_VERSION)


@query(_VERSIONS_SQL.format(batch=f"CASE WHEN ts <= TIMESTAMP '{MARK}' THEN 1 ELSE 2 END", source="events"))
def scd2_watermarked(spark: SparkSession, d: str) -> DataFrame:
    """A second batch that resends the first: only what is newer than the watermark is applied."""
    log = _t(spark, d, "events").select("user_id", "event_type", "ts")
    first = apply_history(None, log.where(F.col("ts") <= F.lit(MARK).cast("timestamp_ntz")), _HISTORY, 1)
    return apply_history(first, newer_than(log, "ts", MARK), _HISTORY, 2).select(*_VERSION)


@query(
    """SELECT l_orderkey || '-' || l_linenumber AS claim_id, v.sk AS policy_sk, v.sk IS NOT NULL AS customer_known,
      CAST(l_orderkey AS VARCHAR) AS policy_id, v.line AS product_line, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS loss_date_key,
      CAST(strftime(l_shipdate + INTERVAL 3 DAY, '%Y%m%d') AS INTEGER) AS reported_date_key,
      CAST(l_extendedprice AS DECIMAL(14,2)) AS claim_amount, CAST(l_quantity AS DECIMAL(14,2)) AS paid_amount,
      CAST(CAST(l_extendedprice AS DECIMAL(14,2)) - CAST(l_quantity AS DECIMAL(14,2)) AS DECIMAL(15,2)) AS outstanding_amount,
      l_returnflag AS claim_status, l_linestatus AS cause_of_loss, CAST(1 AS INTEGER) AS batch_id
    FROM lineitem LEFT JOIN (
      SELECT o_orderkey AS k, o_orderkey * 2 AS sk, o_orderpriority AS line, o_orderdate AS a, o_orderdate + INTERVAL 60 DAY AS b FROM orders
      UNION ALL SELECT o_orderkey, o_orderkey * 2 + 1, 'LATE', o_orderdate + INTERVAL 60 DAY, TIMESTAMP '9999-12-31' FROM orders WHERE o_orderkey % 2 = 0
    ) v ON v.k = l_orderkey AND CAST(l_shipdate AS DATE) >= v.a AND CAST(l_shipdate AS DATE) < v.b"""
)
def fact_claims(spark: SparkSession, d: str) -> DataFrame:
    """Line items as claims, bound to one of the two versions that an order stands for."""
    start, later = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days")
    orders = _t(spark, d, "orders").withColumn("policy_id", F.col("o_orderkey").cast("string"))
    columns = lambda sk, line, a, b: (
        sk.alias("policy_sk"), "policy_id", F.col("o_custkey").alias("customer_id"), line.alias("product_line"),
        a.alias("effective_from"), b.alias("effective_to"),
    )
    end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    versions = orders.select(*columns(F.col("o_orderkey") * 2, F.col("o_orderpriority"), start, later)).unionByName(
        orders.where("o_orderkey % 2 = 0").select(*columns(F.col("o_orderkey") * 2 + 1, F.lit("LATE"), later, end))
    )
    day = F.col("l_shipdate").cast("date")
    claims = _t(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"),
        F.col("l_orderkey").cast("string").alias("policy_id"),
        day.alias("loss_date"),
        F.date_add(day, 3).alias("reported_date"),
        _money("l_extendedprice").alias("claim_amount"),
        _money("l_quantity").alias("paid_amount"),
        F.col("l_returnflag").alias("claim_status"),
        F.col("l_linestatus").alias("cause_of_loss"),
        F.col("l_shipdate").alias("last_modified"),
        F.lit(1).alias("batch_id"),
    )
    found = marts.fact_claims(claims, versions)
    return found.withColumn("customer_known", F.col("customer_sk").isNotNull()).drop("customer_sk", "last_modified")


@query(
    """SELECT l_orderkey, l_linenumber, count(*) - 1 AS superseded, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS kept FROM (
      SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_linenumber = 1)
    GROUP BY l_orderkey, l_linenumber"""
)
def exact_resends(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are sent twice as they are: ties fall to the content's hash, one row of each key stays."""
    lines = _lines(spark, d)
    good, rest = split_latest(lines.unionByName(lines.where("l_linenumber = 1")), _LINE_KEY, _LINE_NEW)
    lost = rest.groupBy(*_LINE_KEY).agg(F.count("*").alias("superseded"))
    day = F.col("l_shipdate").cast("date").cast("string").alias("kept")
    return good.select(*_LINE_KEY, day).join(lost, _LINE_KEY, "left").fillna(0, ["superseded"])


@query(
    f"""SELECT count(*) FILTER (NOT passed AND severity = 'critical') = 0 AS published,
      coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (NOT passed AND severity = 'critical'), '') AS held_back_by,
      coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (NOT passed AND severity = 'warning'), '') AS noted
    FROM ({" UNION ALL ".join(map(_rule_sql, _RULE_SQL))})"""
)
def dq_gate(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: _t(spark, d, t) for t in ("lineitem", "orders", "customer", "events")}
    found = dq.report(dq.evaluate(tables, dq.parse_rules(_RULES)), 1)
    row = (found["published"], ",".join(sorted(found["held_back_by"])), ",".join(sorted(found["noted"])))
    return spark.createDataFrame([row], "published boolean, held_back_by string, noted string")


# ------------------------------------------------------------------ flagship
@query(
    f"""SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS lines,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(38,2)) AS amount
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem WHERE l_quantity <= 45)
    WHERE n = 1 GROUP BY ALL"""
)
def latest_lines_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Quarantine, latest row per key and a monthly aggregate in one plan."""
    lines = _t(spark, d, "lineitem").select(*_LINE_COLUMNS.split(", "), "l_returnflag", "l_extendedprice")
    good = lines.withColumn("reason_code", first_failing([(F.col("l_quantity") > 45, "OUT_OF_RANGE")])).where("reason_code is null")
    newest = ranked_latest(good, _LINE_KEY, _LINE_NEW, ties=_LINE_TIES).where("__rank = 1")
    return newest.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag").agg(
        F.count("*").alias("lines"), F.sum(_money("l_extendedprice")).cast("decimal(38,2)").alias("amount")
    )
