"""Sources, memberships and stored runs: tri-state patches, archiving, run headers with cases, wire rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.match import CONFIG
from tally.sources.statements import PDF_PROFILES

#: Dialects that a source may name, and the longest name a patch may give.
DIALECTS, NAME_CHARS = ("generic", "subfielded"), 80
#: The names under which a wire shows the fields that a problem is about.
DIALECT_FIELD, PROFILE_FIELD = "formatDialect", "pdfProfile"


def _known(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)


def source_problem(name: Column, currency: Column, dialect: Column, profile: Column) -> Column:
    """Which field of a new source is not acceptable, or null."""
    return (
        F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) == 0, "name")
        .when(F.length(F.trim(F.coalesce(currency, F.lit("")))) != 3, "currency")
        .when(~_known(dialect, DIALECTS), DIALECT_FIELD)
        .when(~_known(profile, tuple(PDF_PROFILES)), PROFILE_FIELD)
    )


def patch_sources(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Every source (id, tenant_id, name, format_dialect, pdf_profile, disabled, problem, changed) after its patch.

    A patch (tenant_id, source_id, name, patch_dialect, format_dialect,
    patch_profile, pdf_profile, disabled) names a source at most once. A null
    name or disabled keeps the old one; a dialect or profile is kept, cleared
    or set: it changes only where its patch_ flag is true, to null too. A patch
    with a ``problem`` changes nothing; one from another tenant meets no source.
    """
    p = patches.select(
        "tenant_id", F.col("source_id").alias("id"), F.col("name").alias("new_name"), "patch_dialect", F.col("format_dialect").alias("new_dialect"),
        "patch_profile", F.col("pdf_profile").alias("new_profile"), F.col("disabled").alias("new_disabled"),
    )
    j = sources.join(p.withColumn("patched", F.lit(True)), ["tenant_id", "id"], "left")
    trimmed = F.length(F.trim("new_name"))
    problem = (
        F.when((trimmed == 0) | (trimmed > NAME_CHARS), "name")
        .when(F.col("patch_dialect") & ~_known(F.col("new_dialect"), DIALECTS), DIALECT_FIELD)
        .when(F.col("patch_profile") & ~_known(F.col("new_profile"), tuple(PDF_PROFILES)), PROFILE_FIELD)
    )
    j = j.withColumn("problem", problem).withColumn("changed", F.coalesce("patched", F.lit(False)) & F.col("problem").isNull())
    put = lambda flag, new, old: F.when(F.col("changed") & flag, F.col(new)).otherwise(F.col(old))
    return j.select(
        "id", "tenant_id",
        put(F.col("new_name").isNotNull(), "new_name", "name").alias("name"),
        put(F.col("patch_dialect"), "new_dialect", "format_dialect").alias("format_dialect"),
        put(F.col("patch_profile"), "new_profile", "pdf_profile").alias("pdf_profile"),
        put(F.col("new_disabled").isNotNull(), "new_disabled", "disabled").alias("disabled"),
        "problem", "changed",
    )


def my_tenants(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """(user_id, tenant_id, tenant_name, role): each user's tenants; a membership of an unknown tenant does not show."""
    return memberships.join(tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name")), "tenant_id").select("user_id", "tenant_id", "tenant_name", "role")


def run_headers(stats: DataFrame, started_at: Column) -> DataFrame:
    """A completed run per row of statistics by run_id, started and completed at the same time."""
    return stats.select("run_id", F.lit("completed").alias("status"), started_at.alias("started_at"), started_at.alias("completed_at"), F.lit(CONFIG["version"]).alias("config_version"), *[c for c in stats.columns if c != "run_id"])


def open_cases(breaks: DataFrame) -> DataFrame:
    """(id, run_id, break_id, assignee_id, status): a new case for each numbered break, open and nobody's."""
    return breaks.select(F.concat(F.lit("case-"), "run_id", F.lit("-"), F.col("ordinal")).alias("id"), "run_id", F.col("id").alias("break_id"), F.lit(None).cast("string").alias("assignee_id"), F.lit("open").alias("status"))


def run_txn_ids(decisions: DataFrame, breaks: DataFrame) -> DataFrame:
    """(run_id, txn_id): the ids that a run's decisions and breaks name, each once."""
    both = decisions.select("run_id", "txn_ids").unionByName(breaks.select("run_id", "txn_ids"))
    return both.select("run_id", F.explode("txn_ids").alias("txn_id")).distinct()


def wire(txns: DataFrame) -> DataFrame:
    """(id, body): canonical transactions as JSON objects with camel-case names, absent optional fields left out."""
    camel = lambda c: "".join(w.capitalize() if k else w for k, w in enumerate(c.split("_")))
    body = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(camel(c)) if c == "description" else F.col(c).alias(camel(c)) for c in txns.columns])
    return txns.select("id", F.to_json(body, {"ignoreNullFields": "true"}).alias("body"))
