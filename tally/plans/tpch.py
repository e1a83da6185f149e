"""Reconciliation inputs derived from the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = """
SELECT concat('A-', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS id,
  concat('tenant-', CAST(o_custkey % 4 AS STRING)) AS tenant_id, 'ledger' AS source_id,
  concat('ORD-', CAST(o_orderkey AS STRING)) AS external_ref, CAST(o_orderdate AS DATE) AS value_date,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
  CASE WHEN o_custkey % 3 = 0 THEN 'GBP' WHEN o_custkey % 3 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS direction,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('AC', CAST(o_custkey AS STRING)) END AS counterparty_account,
  CAST(NULL AS STRING) AS counterparty_bic
FROM orders"""

BANK = f"""
SELECT concat('B-', substr(id, 3)) AS id, tenant_id, 'bank' AS source_id,
  CASE WHEN k % 3 = 0 THEN concat('BNK-', CAST(k AS STRING)) ELSE external_ref END AS external_ref,
  CAST(value_date + CAST(k % 4 AS INT) AS DATE) AS value_date,
  amount_minor + CASE WHEN k % 5 = 0 THEN 1 + k % 1000 ELSE 0 END AS amount_minor,
  currency, direction, CASE WHEN k % 7 = 0 THEN NULL ELSE counterparty_account END AS counterparty_account, counterparty_bic
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) p WHERE k % 17 <> 0
UNION ALL
SELECT concat('B-', substr(id, 3), 'd') AS id, tenant_id, 'bank' AS source_id, external_ref, value_date, amount_minor,
  currency, direction, counterparty_account, counterparty_bic
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) p WHERE k % 29 = 0
UNION ALL
SELECT concat('B-', substr(id, 3), 'e') AS id, tenant_id, 'bank' AS source_id, external_ref, value_date, amount_minor,
  currency, direction, counterparty_account, counterparty_bic
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM ({LEDGER}) l) p WHERE k % 29 = 0"""

#: The run of a row, in SQL that Spark and DuckDB share: a calendar month of value dates of one tenant.
RUN_OF = "concat('run-', tenant_id, '-', substr(CAST(value_date AS STRING), 1, 7))"


def by_run(side: DataFrame) -> DataFrame:
    """``side`` with run_id: each calendar month of value dates of a tenant is a run, its window the whole month."""
    return side.withColumn("run_id", F.expr(RUN_OF))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``sf_dir`` that it names."""
    for name in ("orders", "events", "customer", "nation"):
        if f"FROM {name}" in sql or f"JOIN {name}" in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row of both sides, with its run."""
    return by_run(frame(spark, sf_dir, LEDGER)), by_run(frame(spark, sf_dir, BANK))
