"""Queries of the listings and dashboards and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import listing
from tally.plans.tpch import LEDGER, frame

TENANT, AS_OF = "tenant-1", "1998-06-01 12:00:00"

BREAKS = f"""
SELECT concat('brk-', CAST(k AS STRING)) AS id, tenant_id, concat('run-', CAST(k % 50 AS STRING)) AS run_id,
  CASE k % 4 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'partial' WHEN 2 THEN 'duplicate' ELSE 'unmatched' END AS type,
  CASE k % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'pending_approval' WHEN 3 THEN 'resolved' ELSE 'written_off' END AS status,
  amount_minor AS value_minor, currency, CASE WHEN k % 3 = 0 THEN NULL ELSE concat('user-', CAST(k % 1009 AS STRING)) END AS assignee_id,
  t.id AS txn_id, CAST(DATE '1998-06-01' - CAST(k % 45 AS INT) AS TIMESTAMP) AS opened_at
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) t"""

RUNS = f"""
SELECT concat('run-', CAST(k AS STRING)) AS id, tenant_id, concat('Run ', external_ref) AS name,
  CASE k % 3 WHEN 0 THEN 'bank' ELSE 'card' END AS source_a_id, 'ledger' AS source_b_id,
  CASE WHEN k % 4 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(value_date AS TIMESTAMP) AS started_at,
  CAST(amount_minor % 1000 AS DOUBLE) / 10e0 AS match_rate_pct
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) t"""

SOURCES = """
SELECT concat('src-', CAST(n_nationkey AS STRING)) AS id, concat('tenant-', CAST(n_nationkey % 4 AS STRING)) AS tenant_id,
  n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency, n_nationkey % 6 = 5 AS disabled
FROM nation"""

BY_SOURCE = """
SELECT concat('src-', CAST(o_custkey % 21 AS STRING)) AS source_id, concat('tenant-', CAST((o_custkey % 21) % 4 AS STRING)) AS tenant_id FROM orders"""

USERS = """SELECT concat('user-', CAST(c_custkey AS STRING)) AS id, c_name AS name FROM customer"""
MEMBERSHIPS = """
SELECT concat('user-', CAST(c_custkey AS STRING)) AS user_id, concat('tenant-', CAST(c_custkey % 2 AS STRING)) AS tenant_id,
  CASE c_custkey % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'approver' ELSE 'admin' END AS role FROM customer"""

_as_of = lambda: F.lit(AS_OF).cast("timestamp")


def _by_type(breaks):
    return listing.share_of_max(listing.breaks_by_type(breaks, TENANT))


def _enriched(spark, sf_dir, breaks, users):
    b = breaks.where(F.col("tenant_id") == TENANT).withColumn("txn_ids", F.array("txn_id"))
    return listing.enrich_breaks(b, frame(spark, sf_dir, LEDGER), users).select("id", "first_txn", "first_ref", "assignee")


def _detail(spark, sf_dir, breaks):
    b = breaks.select("id", F.array("txn_id", F.concat(F.lit("B"), F.substring("txn_id", 2, 99)), F.lit("A-0000000001")).alias("txn_ids"))
    d = listing.run_detail(b, frame(spark, sf_dir, LEDGER))
    return d.select("id", F.concat_ws(",", F.transform("txns", lambda t: F.coalesce(t["external_ref"], F.lit("?")))).alias("refs"), F.aggregate("txns", F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(t["amount_minor"], F.lit(0))).alias("total_minor"))


def _table(sql):
    return lambda spark, sf_dir: frame(spark, sf_dir, sql)


breaks, runs, users, memberships = map(_table, (BREAKS, RUNS, USERS, MEMBERSHIPS))
QUERIES = {
    "dashboard_kpis": lambda s, d: listing.dashboard(runs(s, d), breaks(s, d), TENANT, _as_of()),
    "breaks_by_type": lambda s, d: _by_type(breaks(s, d)),
    "breaks_by_ageing": lambda s, d: listing.breaks_by_ageing(breaks(s, d), TENANT, _as_of()),
    "list_runs": lambda s, d: listing.list_runs(runs(s, d), TENANT, status="completed", source_id="bank", started_from=F.lit("1996-01-01").cast("timestamp"), search=" ORD-1 ").select("id", "name", "started_at"),
    "list_breaks": lambda s, d: listing.list_breaks(breaks(s, d), TENANT, _as_of(), status="open", bucket="8-30d").select("id", "type", "ageing_days", "ageing_bucket", "value_minor"),
    "unassigned_breaks": lambda s, d: listing.list_breaks(breaks(s, d), TENANT, _as_of(), unassigned=True).select("id", "status", "ageing_bucket"),
    "recent_runs": lambda s, d: listing.recent_runs(runs(s, d), TENANT).select("id", "name", "started_at", "match_rate_pct"),
    "source_counts": lambda s, d: listing.source_counts(frame(s, d, SOURCES), frame(s, d, BY_SOURCE), TENANT),
    "source_counts_with_archived": lambda s, d: listing.source_counts(frame(s, d, SOURCES), frame(s, d, BY_SOURCE), TENANT, include_archived=True),
    "break_enrichment": lambda s, d: _enriched(s, d, breaks(s, d), users(s, d)),
    "run_detail": lambda s, d: _detail(s, d, breaks(s, d)),
    "member_list": lambda s, d: listing.members(users(s, d), memberships(s, d), TENANT),
}

_OPEN = "status IN ('open', 'investigating', 'pending_approval')"
_AGED = f"""SELECT *, CASE WHEN ageing_days <= 1 THEN '0-1d' WHEN ageing_days <= 7 THEN '2-7d' WHEN ageing_days <= 30 THEN '8-30d' ELSE '30d+' END AS ageing_bucket
FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(opened_at)) / 86400000000) AS BIGINT) AS ageing_days FROM ({BREAKS}) b WHERE tenant_id = '{TENANT}') a"""

ORACLES = {
    "dashboard_kpis": f"""
SELECT (SELECT coalesce(round(avg(match_rate_pct) * 10) / 10, 0e0) FROM ({RUNS}) r WHERE tenant_id = '{TENANT}' AND status = 'completed') AS match_rate_pct,
  count(*) FILTER ({_OPEN}) AS open_breaks, CAST(coalesce(sum(value_minor) FILTER ({_OPEN}), 0) AS BIGINT) AS value_at_risk_minor,
  CASE WHEN count(*) FILTER (status IN ('resolved', 'written_off')) = 0 THEN 100e0 ELSE
    round(count(*) FILTER (status IN ('resolved', 'written_off') AND ageing_days <= 7) / count(*) FILTER (status IN ('resolved', 'written_off')) * 1000) / 10 END AS sla_pct,
  coalesce(arg_min(currency, id), 'GBP') AS currency
FROM ({_AGED}) x""",
    "breaks_by_type": f"""
SELECT position, type, count, CAST(round(count / greatest(max(count) OVER (), 1) * 100) AS BIGINT) AS percent FROM (
  SELECT CAST(position AS INT) AS position, v.type, count(b.id) AS count FROM (VALUES (0, 'unmatched'), (1, 'partial'), (2, 'duplicate'), (3, 'break')) v(position, type)
  LEFT JOIN ({BREAKS}) b ON b.type = v.type AND b.tenant_id = '{TENANT}' GROUP BY ALL) q""",
    "breaks_by_ageing": f"""
SELECT CAST(position AS INT) AS position, v.ageing_bucket, count(b.id) AS count FROM (VALUES (0, '0-1d'), (1, '2-7d'), (2, '8-30d'), (3, '30d+')) v(position, ageing_bucket)
LEFT JOIN (SELECT * FROM ({_AGED}) x WHERE {_OPEN}) b ON b.ageing_bucket = v.ageing_bucket GROUP BY ALL""",
    "list_runs": f"""SELECT id, name, started_at FROM ({RUNS}) r WHERE tenant_id = '{TENANT}' AND status = 'completed' AND (source_a_id = 'bank' OR source_b_id = 'bank')
  AND started_at >= TIMESTAMP '1996-01-01' AND contains(lower(name), 'ord-1')""",
    "list_breaks": f"SELECT id, type, ageing_days, ageing_bucket, value_minor FROM ({_AGED}) x WHERE status = 'open' AND ageing_bucket = '8-30d'",
    "unassigned_breaks": f"SELECT id, status, ageing_bucket FROM ({_AGED}) x WHERE assignee_id IS NULL",
    "recent_runs": f"SELECT id, name, started_at, match_rate_pct FROM ({RUNS}) r WHERE tenant_id = '{TENANT}' AND status = 'completed' ORDER BY started_at DESC, id LIMIT 5",
    "source_counts": f"""SELECT s.id, s.name, s.currency, s.disabled, count(t.source_id) AS txn_count FROM ({SOURCES}) s
LEFT JOIN ({BY_SOURCE}) t ON t.source_id = s.id AND t.tenant_id = '{TENANT}' WHERE s.tenant_id = '{TENANT}' AND NOT s.disabled GROUP BY ALL""",
    "source_counts_with_archived": f"""SELECT s.id, s.name, s.currency, s.disabled, count(t.source_id) AS txn_count FROM ({SOURCES}) s
LEFT JOIN ({BY_SOURCE}) t ON t.source_id = s.id AND t.tenant_id = '{TENANT}' WHERE s.tenant_id = '{TENANT}' GROUP BY ALL""",
    "break_enrichment": f"""SELECT b.id, b.txn_id AS first_txn, l.external_ref AS first_ref, coalesce(u.name, b.assignee_id) AS assignee
FROM ({BREAKS}) b LEFT JOIN ({LEDGER}) l ON l.id = b.txn_id LEFT JOIN ({USERS}) u ON u.id = b.assignee_id WHERE b.tenant_id = '{TENANT}'""",
    "run_detail": f"""SELECT b.id, concat(l.external_ref, ',?,ORD-1') AS refs, l.amount_minor + (SELECT amount_minor FROM ({LEDGER}) z WHERE id = 'A-0000000001') AS total_minor
FROM ({BREAKS}) b JOIN ({LEDGER}) l ON l.id = b.txn_id""",
    "member_list": f"SELECT u.id, u.name, m.role FROM ({MEMBERSHIPS}) m JOIN ({USERS}) u ON u.id = m.user_id WHERE m.tenant_id = '{TENANT}'",
}
