"""Queries of sources, memberships and stored runs and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import admin, match
from tally.plans.listing import MEMBERSHIPS
from tally.plans.matching import BY_RUN, ORACLES as MATCHED
from tally.plans.tpch import LEDGER, frame, sides

SOURCES = """
SELECT concat('src-', CAST(c_custkey AS STRING)) AS id, concat('tenant-', CAST(c_custkey % 4 AS STRING)) AS tenant_id, c_name AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'subfielded' END AS format_dialect, CASE WHEN c_custkey % 5 = 0 THEN 'acmebank' END AS pdf_profile,
  c_custkey % 6 = 5 AS disabled
FROM customer"""

#: Two of three sources get a patch; one in thirteen of these comes from another tenant.
PATCHES = """
SELECT concat('tenant-', CAST((c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END) % 4 AS STRING)) AS tenant_id, concat('src-', CAST(c_custkey AS STRING)) AS source_id,
  CASE c_custkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat('New ', c_name) WHEN 2 THEN repeat('x', 81) END AS name,
  c_custkey % 2 = 0 AS patch_dialect, CASE c_custkey % 10 WHEN 0 THEN 'generic' WHEN 2 THEN 'subfielded' WHEN 4 THEN 'other' END AS format_dialect,
  c_custkey % 4 = 1 AS patch_profile, CASE c_custkey % 8 WHEN 1 THEN 'acmebank' END AS pdf_profile,
  CASE c_custkey % 9 WHEN 0 THEN true WHEN 1 THEN false END AS disabled
FROM customer WHERE c_custkey % 3 <> 0"""

TENANTS = "SELECT concat('tenant-', CAST(n_nationkey AS STRING)) AS id, n_name AS name FROM nation"


def _patched(spark, sf_dir):
    return admin.patch_sources(frame(spark, sf_dir, SOURCES), frame(spark, sf_dir, PATCHES))


def _tenants(spark, sf_dir):
    return admin.my_tenants(frame(spark, sf_dir, MEMBERSHIPS), frame(spark, sf_dir, TENANTS))


def _run_headers(spark, sf_dir):
    stats = match.run_stats(*match.settle(*sides(spark, sf_dir), by=BY_RUN), by=BY_RUN)
    started = F.to_timestamp(F.concat(F.right("run_id", F.lit(7)), F.lit("-01")))
    return admin.run_headers(stats, started)


def _cases(spark, sf_dir):
    return admin.open_cases(match.reconcile(*sides(spark, sf_dir), by=BY_RUN)[1])


def _txn_ids(spark, sf_dir):
    return admin.run_txn_ids(*match.settle(*sides(spark, sf_dir), by=BY_RUN))


def _wire(spark, sf_dir):
    rows = frame(spark, sf_dir, LEDGER).select("id", "source_id", "external_ref", "value_date", "amount_minor", "currency", "direction", "counterparty_account", "counterparty_bic")
    return admin.wire(rows)


QUERIES = {"source_patch": _patched, "my_tenants": _tenants, "run_headers": _run_headers, "run_cases": _cases, "run_txn_ids": _txn_ids, "wire_transactions": _wire}

_SET = lambda flag, new, old: f"CASE WHEN changed AND {flag} THEN {new} ELSE {old} END"
ORACLES = {
    "source_patch": f"""
WITH j AS (
  SELECT s.*, p.source_id IS NOT NULL AS patched, p.name AS new_name, coalesce(p.patch_dialect, false) AS patch_dialect, p.format_dialect AS new_dialect,
    coalesce(p.patch_profile, false) AS patch_profile, p.pdf_profile AS new_profile, p.disabled AS new_disabled,
    CASE WHEN length(trim(p.name)) = 0 OR length(trim(p.name)) > 80 THEN 'name' WHEN p.patch_dialect AND p.format_dialect NOT IN ('generic', 'subfielded') THEN 'formatDialect'
      WHEN p.patch_profile AND p.pdf_profile <> 'acmebank' THEN 'pdfProfile' END AS problem
  FROM ({SOURCES}) s LEFT JOIN ({PATCHES}) p ON p.source_id = s.id AND p.tenant_id = s.tenant_id
), c AS (SELECT *, patched AND problem IS NULL AS changed FROM j)
SELECT id, tenant_id, {_SET('new_name IS NOT NULL', 'new_name', 'name')} AS name, {_SET('patch_dialect', 'new_dialect', 'format_dialect')} AS format_dialect,
  {_SET('patch_profile', 'new_profile', 'pdf_profile')} AS pdf_profile, {_SET('new_disabled IS NOT NULL', 'new_disabled', 'disabled')} AS disabled, problem, changed
FROM c""",
    "my_tenants": f"SELECT m.user_id, m.tenant_id, t.name AS tenant_name, m.role FROM ({MEMBERSHIPS}) m JOIN ({TENANTS}) t ON t.id = m.tenant_id",
    "run_headers": f"""SELECT *, 'completed' AS status, CAST(concat(right(run_id, 7), '-01') AS TIMESTAMP) AS started_at, CAST(concat(right(run_id, 7), '-01') AS TIMESTAMP) AS completed_at,
  'v1.1' AS config_version FROM ({MATCHED['match_run_stats']}) s""",
    "run_cases": f"SELECT concat('case-', run_id, '-', ordinal) AS id, run_id, id AS break_id, CAST(NULL AS VARCHAR) AS assignee_id, 'open' AS status FROM ({MATCHED['match_breaks']}) b",
    "run_txn_ids": f"SELECT run_id, first_txn AS txn_id FROM ({MATCHED['match_decisions']}) d UNION SELECT run_id, second_txn FROM ({MATCHED['match_decisions']}) e UNION SELECT run_id, txn_id FROM ({MATCHED['match_breaks']}) b",
    "wire_transactions": f"""SELECT id, concat('{{"id":"', id, '","sourceId":"', source_id, '","externalRef":"', external_ref, '","valueDate":"', CAST(value_date AS VARCHAR), '","amountMinor":', CAST(amount_minor AS VARCHAR),
  ',"currency":"', currency, '","direction":"', direction, '"', CASE WHEN counterparty_account IS NULL THEN '' ELSE concat(',"counterpartyAccount":"', counterparty_account, '"') END, '}}') AS body FROM ({LEDGER}) l""",
}
