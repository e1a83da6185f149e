"""Queries of the seeded store, of display forms and of small checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import admin, cases, listing, match, seed
from tally.functions.exprs import display_money
from tally.plans.ingest import camt_files, csv_files
from tally.plans.listing import MEMBERSHIPS
from tally.plans.matching import BY_RUN, ORACLES as MATCHED
from tally.plans.tpch import BANK, LEDGER, frame, sides
from tally.schemas import decode, violations
from tally.sources import statements as st
from tally.storage import new_path, written

USERS = """
SELECT concat('user-C', CAST(c_custkey AS STRING)) AS id, c_name AS name, concat('tenant-', CAST(c_custkey % 4 AS STRING)) AS tenant_id,
  CASE c_custkey % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'approver' ELSE 'admin' END AS role,
  CASE WHEN c_custkey % 4 = 0 THEN concat('c', CAST(c_custkey AS STRING), '@tally.test') END AS email
FROM customer"""


def _tenant(run_id) -> F.Column:
    return F.substring_index(F.substring(run_id, 5, 100), "-", 2)


def seed_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """All tables of the store from orders and customers, runs matched and their breaks opened as cases."""
    a, b = sides(spark, sf_dir)
    decisions, breaks = (written(x, "seed") for x in match.reconcile(a, b, by=BY_RUN))
    txns = a.unionByName(b)
    users, memberships = seed.backfill(frame(spark, sf_dir, USERS))
    tenants = txns.select(F.col("tenant_id").alias("id")).distinct()
    sources = txns.select(F.concat_ws("-", "tenant_id", "source_id").alias("id"), "tenant_id", F.col("source_id").alias("name")).distinct()
    stats = match.run_stats(decisions, breaks, BY_RUN)
    of_tenant = lambda df: df.withColumn("tenant_id", _tenant(F.col("run_id")))
    opened = admin.open_cases(breaks)
    return {
        "tenants": tenants, "users": users, "memberships": memberships, "sources": sources,
        "transactions": txns.withColumn("source_id", F.concat_ws("-", "tenant_id", "source_id")).drop("run_id"),
        "runs": of_tenant(stats).withColumnRenamed("run_id", "id"), "decisions": of_tenant(decisions), "breaks": of_tenant(breaks), "cases": of_tenant(opened),
        "case_events": of_tenant(opened).select(F.concat("id", F.lit("-1")).alias("id"), "tenant_id", F.col("id").alias("case_id"), F.lit(1).alias("seq"), F.lit("comment").alias("kind")),
    }


def _seeded(spark, sf_dir):
    """The store loaded twice, then one tenant's decisions replaced by themselves: rows of each table and tenant, and rows that refer to nothing."""
    root, tables = new_path(spark, "store"), seed_tables(spark, sf_dir)
    for _ in range(2):
        seed.load(spark, root, tables)
    seed.replace_tenants(root, "decisions", tables["decisions"].where("tenant_id = 'tenant-1'"))
    stored = {name: seed.read(spark, root, name, df) for name, df in tables.items()}
    out = None
    for name, df in stored.items():
        part = df.select(F.lit(name).alias("table"), F.col("tenant_id") if "tenant_id" in df.columns else F.lit("all").alias("tenant_id"))
        out = part if out is None else out.unionByName(part)
    lost = seed.orphans(stored).select(F.concat("table", F.lit("."), "column").alias("table"), F.lit("orphans").alias("tenant_id"), "n")
    return out.groupBy("table", "tenant_id").agg(F.count("*").alias("n")).unionByName(lost)


def _backfill(spark, sf_dir):
    users, memberships = seed.backfill(frame(spark, sf_dir, USERS))
    return memberships.join(users.withColumnRenamed("id", "user_id"), "user_id")


def _canonical(spark, sf_dir):
    """Statements of two formats as canonical transactions, with the fingerprint of their files' contents."""
    delimited, mapping = csv_files(spark, sf_dir, "both")
    parts = []
    for source, files, parsed in (("src-camt", camt := camt_files(spark, sf_dir), st.parse_camt053(camt)), ("src-csv", delimited, st.parse_csv(delimited, mapping))):
        prints = st.fingerprint(files)
        accepted = st.gate(parsed)[0]
        txns = st.canonical(accepted, "tenant-x", source, "CHF")
        parts.append(txns.join(accepted.select("external_ref", "path"), "external_ref").join(prints, "path"))
    return parts[0].unionByName(parts[1]).select("id", "source_id", "external_ref", "posted_at", "currency", "amount_minor", "sha256", "bytes")


def _by_text_id(spark, sf_dir):
    """Decisions of each run in the order of their ids as text, in which -10 comes before -2, with the number that they were given."""
    decisions, _ = match.reconcile(*sides(spark, sf_dir), by=BY_RUN)
    return listing.by_text_id(decisions).select("run_id", "id", "ordinal", "place")


def _sorted_breaks(spark, sf_dir):
    """A listing that was sorted by amount, then the other way round, then not at all; places count in each order."""
    rows = frame(spark, sf_dir, LEDGER).select("id", "amount_minor", "currency")
    parts = []
    for clicks in (1, 2, 3):
        state = listing.sort_state(None, "amount_minor")
        for _ in range(clicks - 1):
            state = listing.sort_state(state, "amount_minor")
        parts.append(listing.numbered(rows, state, "id").select(F.lit(clicks).alias("clicks"), "place", "id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _money(spark, sf_dir):
    rows = frame(spark, sf_dir, LEDGER).withColumn("currency", F.expr("CASE WHEN amount_minor % 4 = 0 THEN 'JPY' WHEN amount_minor % 4 = 1 THEN 'KWD' ELSE currency END"))
    return rows.select("id", display_money(F.when(F.col("amount_minor") % 3 == 0, -F.col("amount_minor")).otherwise(F.col("amount_minor")), F.col("currency")).alias("shown"))


#: Runs that a caller asks for, sources as a caller wants them, and stored words some of which no version knows.
_ASKED = "SELECT o_orderkey AS k, concat('src-', CAST(o_orderkey % 3 AS STRING)) AS a, concat('src-', CAST(o_orderkey % 5 AS STRING)) AS b, CASE o_orderkey % 7 WHEN 0 THEN 'soon' WHEN 1 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day_from, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 - 1 AS INT) AS STRING) AS day_to FROM orders"
_WANTED = "SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 'EURO' ELSE 'EUR' END AS currency, CASE c_custkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'generic' END AS dialect, CASE c_custkey % 6 WHEN 0 THEN 'acmebank' WHEN 1 THEN 'other' END AS profile FROM customer"
_WORDS = "SELECT event_id AS k, event_type, CASE event_type WHEN 'view' THEN 'approver' WHEN 'click' THEN 'admin' WHEN 'error' THEN 'boss' END AS role, CASE event_type WHEN 'view' THEN 'credit' WHEN 'click' THEN 'CREDIT' END AS direction FROM events"


def _requests(spark, sf_dir):
    asked = frame(spark, sf_dir, _ASKED)
    return asked.select(F.lit("run").alias("what"), "k", listing.window_problem(F.col("a"), F.col("b"), F.col("day_from"), F.col("day_to")).alias("problem")).unionByName(
        frame(spark, sf_dir, _WANTED).select(F.lit("source").alias("what"), "k", admin.source_problem(F.col("name"), F.col("currency"), F.col("dialect"), F.col("profile")).alias("problem"))
    )


def _decoded(spark, sf_dir):
    return frame(spark, sf_dir, _WORDS).select("k", decode("role", ("operator", "approver", "admin"), "operator").alias("role"), decode("direction", ("debit", "credit"), "debit").alias("direction"))


def _assigned(spark, sf_dir):
    """Every order as a break; two in three get an assignee, of whom some belong to another tenant and some to none."""
    breaks = frame(spark, sf_dir, "SELECT concat('b-', CAST(o_orderkey AS STRING)) AS id, concat('tenant-', CAST(o_custkey % 4 AS STRING)) AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, CAST(NULL AS STRING) AS assignee_id FROM orders")
    wishes = frame(spark, sf_dir, "SELECT concat('b-', CAST(o_orderkey AS STRING)) AS break_id, concat('user-', CAST(o_custkey + o_orderkey % 3 AS STRING)) AS assignee_id FROM orders WHERE o_orderkey % 3 < 2")
    return cases.assign(breaks, wishes, frame(spark, sf_dir, MEMBERSHIPS))


_ODD_ROWS = f"""SELECT id, concat(source_id, '-', tenant_id) AS source_id, CASE WHEN k % 31 = 0 THEN 'ORD-0' ELSE external_ref END AS external_ref, CASE WHEN k % 37 <> 0 THEN value_date END AS value_date, amount_minor,
  CASE WHEN k % 41 <> 0 THEN currency END AS currency, CASE k % 5 WHEN 0 THEN 'DEUTDEFF' WHEN 1 THEN 'DEUTDEFF500' WHEN 2 THEN 'deutdeff' WHEN 3 THEN 'DEUTDEFF5' END AS counterparty_bic
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) x"""


def _violations(spark, sf_dir):
    """Rows against the constraints of their table: shapes of bank codes, missing values, references that repeat in a source."""
    return violations(frame(spark, sf_dir, _ODD_ROWS))


QUERIES = {
    "table_violations": _violations,
    "seed_store": _seeded,
    "membership_backfill": _backfill,
    "canonical_rows": _canonical,
    "decisions_by_text_id": _by_text_id,
    "tri_state_sort": _sorted_breaks,
    "display_money": _money,
    "request_problems": _requests,
    "decoded_words": _decoded,
    "bulk_assign": _assigned,
}

_ID = lambda s: f"concat('txn-', substr(sha256(concat('{s}', '/', external_ref)), 1, 32))"
_MINOR = "concat(CAST(amount_minor // 100 AS VARCHAR), '.', lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0'))"
_OF = "concat('tenant-', substr(run_id, 12, 1))"
ORACLES = {
    "table_violations": f"""
WITH o AS ({_ODD_ROWS})
SELECT 'bic_shape' AS rule, id FROM o WHERE NOT regexp_full_match(counterparty_bic, '[A-Z0-9]{{8}}([A-Z0-9]{{3}})?')
UNION ALL SELECT 'not_null', id FROM o WHERE currency IS NULL OR value_date IS NULL OR amount_minor IS NULL
UNION ALL SELECT 'unique_ref', min(id) FROM o GROUP BY source_id, external_ref HAVING count(*) > 1""",
    "seed_store": f"""
WITH d AS ({MATCHED['match_decisions']}), b AS ({MATCHED['match_breaks']}), r AS (SELECT run_id FROM ({MATCHED['match_run_stats']}) s),
t AS (SELECT tenant_id, source_id FROM ({LEDGER}) l UNION ALL SELECT tenant_id, source_id FROM ({BANK}) k)
SELECT 'tenants' AS "table", 'all' AS tenant_id, count(DISTINCT tenant_id) AS n FROM t
UNION ALL SELECT 'users', 'all', count(*) FROM customer
UNION ALL SELECT 'memberships', tenant_id, count(*) FROM ({USERS}) u GROUP BY tenant_id
UNION ALL SELECT 'sources', tenant_id, count(DISTINCT source_id) FROM t GROUP BY tenant_id
UNION ALL SELECT 'transactions', tenant_id, count(*) FROM t GROUP BY tenant_id
UNION ALL SELECT 'runs', {_OF}, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'decisions', {_OF}, count(*) FROM d GROUP BY ALL
UNION ALL SELECT v.x, {_OF}, count(*) FROM b, (VALUES ('breaks'), ('cases'), ('case_events')) v(x) GROUP BY ALL
UNION ALL SELECT x, 'orphans', 0 FROM (VALUES {', '.join(f"('{t}.{c}')" for t, c, _ in seed.REFERENCES)}) v(x)""",
    "membership_backfill": f"SELECT id AS user_id, tenant_id, role, name, coalesce(email, concat(lower(replace(id, 'user-', '')), '@example.com')) AS email, false AS disabled FROM ({USERS}) u",
    "canonical_rows": f"""
WITH l AS (SELECT *, {_MINOR} AS amount FROM ({LEDGER}) x),
camt AS (SELECT *, concat('<Ntry><Amt Ccy="', currency, '">', amount, '</Amt><CdtDbtInd>', CASE WHEN direction = 'debit' THEN 'DBIT' ELSE 'CRDT' END, '</CdtDbtInd><ValDt><Dt>', CAST(value_date AS VARCHAR), '</Dt></ValDt><AcctSvcrRef>', external_ref,
  '</AcctSvcrRef><AddtlNtryInf>camt</AddtlNtryInf>', CASE WHEN counterparty_account IS NULL THEN '' ELSE concat('<RltdPties><DbtrAcct><Id><Othr><Id>', counterparty_account, '</Id></Othr></Id></DbtrAcct></RltdPties>') END, '</Ntry>') AS line FROM l),
csv AS (SELECT *, concat(external_ref, ',', CAST(value_date AS VARCHAR), ',', CASE WHEN direction = 'debit' THEN amount ELSE '' END, ',', CASE WHEN direction = 'debit' THEN '' ELSE amount END, ',', coalesce(counterparty_account, '')) AS line FROM l),
files AS (SELECT 'src-camt' AS source_id, value_date, concat('<Document xmlns="urn:x"><Stmt>', string_agg(line, chr(10) ORDER BY id), '</Stmt></Document>') AS content FROM camt GROUP BY value_date
  UNION ALL SELECT 'src-csv', value_date, string_agg(line, chr(10) ORDER BY id) FROM csv GROUP BY value_date)
SELECT CASE f.source_id WHEN 'src-camt' THEN {_ID('src-camt')} ELSE {_ID('src-csv')} END AS id, f.source_id, external_ref, CAST(l.value_date AS TIMESTAMP) AS posted_at,
  CASE f.source_id WHEN 'src-camt' THEN currency ELSE 'CHF' END AS currency, amount_minor, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS bytes
FROM l JOIN files f ON f.value_date = l.value_date""",
    "decisions_by_text_id": f"SELECT run_id, id, ordinal, CAST(row_number() OVER (PARTITION BY run_id ORDER BY id) AS INT) AS place FROM ({MATCHED['match_decisions']}) d",
    "tri_state_sort": f"""SELECT * FROM (
SELECT 1 AS clicks, CAST(row_number() OVER (ORDER BY amount_minor, id) AS INT) AS place, id FROM ({LEDGER}) a
UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY amount_minor DESC, id) AS INT), id FROM ({LEDGER}) b
UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY id) AS INT), id FROM ({LEDGER}) c) s""",
    "display_money": f"""SELECT id, concat(CASE WHEN amount_minor % 3 = 0 AND amount_minor <> 0 THEN '-' ELSE '' END, currency, ' ', CASE currency WHEN 'JPY' THEN format('{{:,}}', amount_minor)
  WHEN 'KWD' THEN concat(format('{{:,}}', amount_minor // 1000), '.', lpad(CAST(amount_minor % 1000 AS VARCHAR), 3, '0')) ELSE concat(format('{{:,}}', amount_minor // 100), '.', lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0')) END) AS shown
FROM (SELECT id, amount_minor, CASE WHEN amount_minor % 4 = 0 THEN 'JPY' WHEN amount_minor % 4 = 1 THEN 'KWD' ELSE currency END AS currency FROM ({LEDGER}) l) x""",
    "request_problems": f"""
SELECT 'run' AS what, k, CASE WHEN a = b THEN 'sources' WHEN try_cast(day_from AS DATE) IS NULL THEN 'from' WHEN try_cast(day_to AS DATE) IS NULL THEN 'to' WHEN day_to < day_from THEN 'window' END AS problem FROM ({_ASKED}) r
UNION ALL SELECT 'source', k, CASE WHEN trim(name) = '' THEN 'name' WHEN length(currency) <> 3 THEN 'currency' WHEN dialect = 'odd' THEN 'formatDialect' WHEN profile = 'other' THEN 'pdfProfile' END FROM ({_WANTED}) s""",
    "decoded_words": "SELECT event_id AS k, CASE event_type WHEN 'view' THEN 'approver' WHEN 'click' THEN 'admin' ELSE 'operator' END AS role, CASE event_type WHEN 'view' THEN 'credit' ELSE 'debit' END AS direction FROM events",
    "bulk_assign": f"""
WITH b AS (SELECT o_orderkey AS k, o_custkey AS c, concat('tenant-', CAST(o_custkey % 4 AS VARCHAR)) AS tenant_id FROM orders),
j AS (SELECT b.*, m.user_id FROM b LEFT JOIN ({MEMBERSHIPS}) m ON m.tenant_id = b.tenant_id AND k % 3 < 2 AND m.user_id = concat('user-', CAST(c + k % 3 AS VARCHAR)))
SELECT concat('b-', CAST(k AS VARCHAR)) AS id, tenant_id, CASE WHEN k % 2 <> 0 THEN 'resolved' WHEN user_id IS NULL THEN 'open' ELSE 'investigating' END AS status, user_id AS assignee_id, user_id IS NOT NULL AS assigned FROM j""",
}
