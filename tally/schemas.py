"""Schemas and vocabularies of the reconciliation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One canonical transaction, whatever statement it came from.
TRANSACTION = (
    "id string, tenant_id string, source_id string, external_ref string, value_date date, posted_at timestamp, "
    "amount_minor bigint, currency string, direction string, counterparty string, description string, "
    "counterparty_bic string, counterparty_account string"
)
#: What a parser gives for one record, before defaults of its source are filled in.
PARSED = (
    "external_ref string, value_date date, posted_at string, amount_minor bigint, currency string, direction string, "
    "counterparty string, description string, counterparty_bic string, counterparty_account string"
)
ROW_ERROR = "row int, field string, message string"
DECISION = "run_id string, ordinal bigint, id string, type string, txn_ids array<string>, score double, config_version string"
AUDIT = "tenant_id string, seq bigint, at string, actor_id string, kind string, payload string, prev_hash binary, hash binary"

#: Fixed values of the data model.
BREAK_TYPES = ("unmatched", "partial", "duplicate", "break")
OPEN_STATUSES = ("open", "investigating", "pending_approval")
CLOSED_STATUSES = ("resolved", "written_off")
AGEING_BUCKETS = ("0-1d", "2-7d", "8-30d", "30d+")
ROLES = ("operator", "approver", "admin")
DEFAULTS = {"role": "operator", "kind": "cross_system", "direction": "debit", "run_status": "running", "decision": "partial", "break_type": "break", "break_status": "open"}


def decode(column: str, allowed: tuple[str, ...], default: str):
    """An enum column; unknown and null values become the default."""
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.lit(default))


def violations(txns: DataFrame) -> DataFrame:
    """(rule, id): rows that break the constraints of the transactions table."""
    bad_bic = txns.where(F.col("counterparty_bic").isNotNull() & ~F.col("counterparty_bic").rlike("^[A-Z0-9]{8}([A-Z0-9]{3})?$")).select(F.lit("bic_shape").alias("rule"), "id")
    missing = txns.where(F.col("currency").isNull() | F.col("amount_minor").isNull() | F.col("value_date").isNull()).select(F.lit("not_null").alias("rule"), "id")
    repeated = txns.groupBy("source_id", "external_ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select(F.lit("unique_ref").alias("rule"), "id")
    return bad_bic.unionByName(missing).unionByName(repeated)
