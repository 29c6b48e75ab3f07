"""Declarations of feeds and entities; the engine is one, the entities are data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeedSpec:
    """A raw file of a batch: all columns land as strings."""

    entity: str
    file: str
    format: str  # csv or json
    columns: tuple[str, ...]
    key: str


@dataclass(frozen=True)
class Attribute:
    """A typed column.  ``kind``: text, title, lower, upper or a SQL type that text is cast to."""

    name: str
    kind: str = "text"
    required: bool = False
    non_negative: bool = False


@dataclass(frozen=True)
class Reference:
    """``column`` must be found in ``table``.``ref_column``, else ``code``."""

    column: str
    table: str
    ref_column: str
    code: str


@dataclass(frozen=True)
class HistorySpec:
    """Type-2 history: a new version wherever a tracked column changes."""

    key: str
    tracked: tuple[str, ...]
    updated: str = "updated_at"
    start: str | None = None  # the first version starts here if that is earlier
    surrogate: str = "version_sk"


@dataclass(frozen=True)
class EntitySpec:
    """How a feed becomes a table."""

    feed: FeedSpec
    attributes: tuple[Attribute, ...]
    updated: str
    table: str
    period: tuple[str, str] | None = None  # the second date may not precede the first
    references: tuple[Reference, ...] = ()
    history: HistorySpec | None = None  # None: latest row per key

    @property
    def key(self) -> str:
        return self.feed.key


# The reason codes of the quarantine contract.
REASONS = {
    "MALFORMED_RECORD": "the line cannot be parsed into the feed's columns",
    "NULL_KEY": "the business key is missing or blank",
    "INVALID_DATE": "a required date is missing, unparseable or out of order",
    "INVALID_NUMBER": "a required number is missing or unparseable",
    "NEGATIVE_AMOUNT": "an amount is below zero",
    "DUPLICATE_KEY": "a newer or equal row of the same key was kept",
    "UNKNOWN_POLICY": "the policy does not exist",
    "UNKNOWN_CUSTOMER": "the customer does not exist",
}

CUSTOMERS = EntitySpec(
    FeedSpec(
        "customers", "customers.csv", "csv",
        ("customer_id", "first_name", "last_name", "date_of_birth", "email", "state", "segment", "updated_at"),
        "customer_id",
    ),
    (
        Attribute("customer_id"), Attribute("first_name", "title"), Attribute("last_name", "title"),
        Attribute("date_of_birth", "date", required=True), Attribute("email", "lower"), Attribute("state", "upper"),
        Attribute("segment", "upper"), Attribute("updated_at", "timestamp", required=True),
    ),
    updated="updated_at",
    table="silver.customers",
)

POLICIES = EntitySpec(
    FeedSpec(
        "policies", "policies.json", "json",
        ("policy_id", "customer_id", "product_line", "premium_annual", "coverage_limit", "deductible", "status",
         "policy_start", "policy_end", "region", "updated_at"),
        "policy_id",
    ),
    (
        Attribute("policy_id"), Attribute("customer_id"), Attribute("product_line", "upper"),
        Attribute("premium_annual", "decimal(12,2)", required=True, non_negative=True),
        Attribute("coverage_limit", "decimal(14,2)", required=True, non_negative=True),
        Attribute("deductible", "decimal(10,2)", required=True, non_negative=True),
        Attribute("status", "upper"), Attribute("policy_start", "date", required=True),
        Attribute("policy_end", "date", required=True), Attribute("region", "upper"),
        Attribute("updated_at", "timestamp", required=True),
    ),
    updated="updated_at",
    table="silver.dim_policy",
    period=("policy_start", "policy_end"),
    references=(Reference("customer_id", "silver.customers", "customer_id", "UNKNOWN_CUSTOMER"),),
    history=HistorySpec(
        "policy_id",
        ("customer_id", "product_line", "premium_annual", "coverage_limit", "deductible", "status", "policy_start",
         "policy_end", "region"),
        start="policy_start",
        surrogate="policy_sk",
    ),
)

CLAIMS = EntitySpec(
    FeedSpec(
        "claims", "claims.csv", "csv",
        ("claim_id", "policy_id", "loss_date", "reported_date", "claim_amount", "paid_amount", "claim_status",
         "cause_of_loss", "last_modified"),
        "claim_id",
    ),
    (
        Attribute("claim_id"), Attribute("policy_id"), Attribute("loss_date", "date", required=True),
        Attribute("reported_date", "date", required=True),
        Attribute("claim_amount", "decimal(14,2)", required=True, non_negative=True),
        Attribute("paid_amount", "decimal(14,2)", required=True, non_negative=True),
        Attribute("claim_status", "upper"), Attribute("cause_of_loss", "upper"),
        Attribute("last_modified", "timestamp", required=True),
    ),
    updated="last_modified",
    table="silver.claims",
    period=("loss_date", "reported_date"),
    references=(Reference("policy_id", "silver.dim_policy", "policy_id", "UNKNOWN_POLICY"),),
)

ENTITIES = (CUSTOMERS, POLICIES, CLAIMS)
