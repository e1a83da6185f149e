"""A dataset's tables as a store that can be filled again: reset, load, replacement of a tenant, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables, each behind those it refers to.
TABLES = ("tenants", "users", "memberships", "sources", "transactions", "runs", "decisions", "breaks", "cases", "case_events")
#: (table, column, table it refers to by id).
REFERENCES = (
    ("memberships", "user_id", "users"), ("memberships", "tenant_id", "tenants"), ("sources", "tenant_id", "tenants"), ("transactions", "source_id", "sources"),
    ("transactions", "tenant_id", "tenants"), ("runs", "tenant_id", "tenants"), ("decisions", "run_id", "runs"), ("breaks", "run_id", "runs"), ("cases", "break_id", "breaks"), ("case_events", "case_id", "cases"),
)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def reset(spark: SparkSession, root: str) -> None:
    """Deletes all tables of the store, those that refer to others first; what is not there is no error."""
    for name in reversed(TABLES):
        files, where = _folder(spark, f"{root}/{name}")
        files.delete(where, True)


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Empties the store and writes ``tables``, those that others refer to first. Run again it leaves the same contents.

    ``tables`` must not be read from the store itself. Tables of a tenant are partitioned by tenant.
    """
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"the store has no table {', '.join(sorted(unknown))}")
    reset(spark, root)
    for name in TABLES:
        if name in tables:
            put = tables[name].write.mode("overwrite")
            (put.partitionBy("tenant_id") if "tenant_id" in tables[name].columns else put).parquet(f"{root}/{name}")


def replace_tenants(root: str, name: str, rows: DataFrame) -> None:
    """Puts ``rows`` in place of what the table has of their tenants; other tenants' files are not touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    """A table of the store with the columns and types of ``like``."""
    return spark.read.schema(like.schema).parquet(f"{root}/{name}").select(*like.columns)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, n): how many rows refer to a row that is not there, for each reference between two given tables."""
    out = None
    for name, column, parent in REFERENCES:
        if name in tables and parent in tables:
            lost = tables[name].where(F.col(column).isNotNull()).join(tables[parent].select(F.col("id").alias(column)), column, "left_anti")
            row = lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(column).alias("column"), "n")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no two of the tables refer to each other")
    return out


def backfill(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, memberships) from users of one tenant each (id, name, tenant_id, role, email).

    A user becomes an identity of its own: tenant and role go to a membership,
    and an email that is missing is made from the id without "user-".
    """
    email = F.coalesce("email", F.concat(F.lower(F.replace(F.col("id"), F.lit("user-"), F.lit(""))), F.lit("@example.com")))
    people = users.select("id", "name", email.alias("email"), F.lit(False).alias("disabled"))
    return people, users.select(F.col("id").alias("user_id"), "tenant_id", "role")
