"""Listings, dashboards and enrichment over runs, breaks, sources and members.

Every operator takes the tenant explicitly; filters that are None are left out
of the plan, so that the rest reach the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.exprs import ageing_bucket, ageing_days
from tally.schemas import AGEING_BUCKETS, BREAK_TYPES, CLOSED_STATUSES, OPEN_STATUSES
from tally.storage import written

#: Days within which a closed break counts as in time.
SLA_DAYS = 7


def of_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant_id)


def aged(breaks: DataFrame, as_of: Column) -> DataFrame:
    """Breaks with ageing_days and ageing_bucket at ``as_of``."""
    with_days = breaks.withColumn("ageing_days", ageing_days(F.col("opened_at"), as_of))
    return with_days.withColumn("ageing_bucket", ageing_bucket(F.col("ageing_days")))


def list_runs(runs: DataFrame, tenant_id: str, status: str | None = None, source_id: str | None = None, started_from: Column | None = None, started_to: Column | None = None, search: str | None = None) -> DataFrame:
    """Runs of a tenant, newest first; ``search`` is a case-insensitive part of the name."""
    out = of_tenant(runs, tenant_id)
    if status is not None:
        out = out.where(F.col("status") == status)
    if source_id is not None:
        out = out.where((F.col("source_a_id") == source_id) | (F.col("source_b_id") == source_id))
    if started_from is not None:
        out = out.where(F.col("started_at") >= started_from)
    if started_to is not None:
        out = out.where(F.col("started_at") <= started_to)
    if search is not None and search.strip():
        out = out.where(F.contains(F.lower("name"), F.lit(search.strip().lower())))
    return out.orderBy(F.desc("started_at"), "id")


def list_breaks(breaks: DataFrame, tenant_id: str, as_of: Column, status: str | None = None, type: str | None = None, assignee: str | None = None, bucket: str | None = None, unassigned: bool = False) -> DataFrame:
    """Breaks of a tenant with their age, newest first; the age bucket is a filter like the others."""
    out = of_tenant(breaks, tenant_id)
    for column, wanted in (("status", status), ("type", type), ("assignee_id", assignee)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    if unassigned:
        out = out.where(F.col("assignee_id").isNull())
    out = aged(out, as_of)
    if bucket is not None:
        out = out.where(F.col("ageing_bucket") == bucket)
    return out.orderBy(F.desc("opened_at"), "id")


def dashboard(runs: DataFrame, breaks: DataFrame, tenant_id: str, as_of: Column) -> DataFrame:
    """One row of key figures.

    match_rate_pct is the mean over completed runs (0 without any), sla_pct
    the share of closed breaks aged at most SLA_DAYS now (100 without any),
    currency that of the break with the smallest id (GBP without any).
    """
    r = of_tenant(runs, tenant_id).where(F.col("status") == "completed").agg(F.coalesce(F.round(F.avg("match_rate_pct") * 10) / 10, F.lit(0.0)).alias("match_rate_pct"))
    is_open, closed = F.col("status").isin(*OPEN_STATUSES), F.col("status").isin(*CLOSED_STATUSES)
    b = aged(of_tenant(breaks, tenant_id), as_of).agg(
        F.count_if(is_open).alias("open_breaks"),
        F.coalesce(F.sum(F.when(is_open, F.col("value_minor"))), F.lit(0)).cast("bigint").alias("value_at_risk_minor"),
        F.count_if(closed).alias("closed"),
        F.count_if(closed & (F.col("ageing_days") <= SLA_DAYS)).alias("in_time"),
        F.coalesce(F.min_by("currency", "id"), F.lit("GBP")).alias("currency"),
    )
    sla = F.when(F.col("closed") == 0, 100.0).otherwise(F.round(F.col("in_time") / F.col("closed") * 1000) / 10)
    # Both sides are one row.
    both = r.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")
    return both.select("match_rate_pct", "open_breaks", "value_at_risk_minor", sla.alias("sla_pct"), "currency")


def _filled(counts: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Counts for each of a few fixed names in their order, 0 where there are none."""
    fixed = counts.sparkSession.createDataFrame(list(enumerate(names)), f"position int, {column} string")
    joined = F.broadcast(fixed).join(counts, column, "left")
    return joined.select("position", column, F.coalesce("count", F.lit(0)).alias("count"))


def breaks_by_type(breaks: DataFrame, tenant_id: str) -> DataFrame:
    return _filled(of_tenant(breaks, tenant_id).groupBy("type").count(), "type", BREAK_TYPES)


def breaks_by_ageing(breaks: DataFrame, tenant_id: str, as_of: Column) -> DataFrame:
    """Open breaks only."""
    is_open = of_tenant(breaks, tenant_id).where(F.col("status").isin(*OPEN_STATUSES))
    return _filled(aged(is_open, as_of).groupBy("ageing_bucket").count(), "ageing_bucket", AGEING_BUCKETS)


def share_of_max(bars: DataFrame) -> DataFrame:
    """Bars of a few rows with their share of the largest in whole per cent."""
    top = F.greatest(F.max("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return bars.withColumn("percent", F.round(F.col("count") / top * 100).cast("bigint"))


def recent_runs(runs: DataFrame, tenant_id: str, top: int = 5) -> DataFrame:
    return of_tenant(runs, tenant_id).where(F.col("status") == "completed").orderBy(F.desc("started_at"), "id").limit(top)


def source_counts(sources: DataFrame, txns: DataFrame, tenant_id: str, include_archived: bool = False) -> DataFrame:
    """Sources by name with their numbers of transactions."""
    s = of_tenant(sources, tenant_id)
    if not include_archived:
        s = s.where(~F.col("disabled"))
    n = of_tenant(txns, tenant_id).groupBy("source_id").agg(F.count("*").alias("txn_count"))
    return s.join(n, s["id"] == n["source_id"], "left").select(s["id"], "name", "currency", "disabled", F.coalesce("txn_count", F.lit(0)).alias("txn_count")).orderBy("name", "id")


def enrich_breaks(breaks: DataFrame, txns: DataFrame, users: DataFrame) -> DataFrame:
    """Breaks with the reference of their first transaction and the assignee's name, or id where there is none."""
    first = breaks.withColumn("first_txn", F.get("txn_ids", F.lit(0)))
    refs = txns.select(F.col("id").alias("first_txn"), F.col("external_ref").alias("first_ref"))
    names = users.select(F.col("id").alias("assignee_id"), F.col("name").alias("user_name"))
    return first.join(refs, "first_txn", "left").join(names, "assignee_id", "left").withColumn("assignee", F.coalesce("user_name", "assignee_id")).drop("user_name")


#: Transactions that more than this share of all ids name are joined apart; there are 1 / HOT of them at most.
HOT = 0.001


def run_detail(decisions: DataFrame, txns: DataFrame) -> DataFrame:
    """Decisions with the transactions of their ids, in the ids' order.

    An id that very many decisions name would be one task's; such ids are
    looked up, a thousand at most, and their transactions broadcast.
    """
    ids = decisions.select("id", F.posexplode("txn_ids").alias("pos", "txn_id"))
    t = txns.select(F.col("id").alias("txn_id"), "external_ref", "amount_minor")
    often = [x for x in (ids.where("txn_id is not null").select("txn_id").freqItems(["txn_id"], HOT).first()[0] or []) if x is not None]
    hot = F.coalesce(F.col("txn_id").isin(often), F.lit(False))
    joined = ids.where(~hot).join(t.where(~hot), "txn_id", "left").unionByName(ids.where(hot).join(F.broadcast(t.where(hot)), "txn_id", "left"))
    found = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "txn_id", "external_ref", "amount_minor"))).alias("txns"))
    return decisions.join(found, "id", "left")


def members(users: DataFrame, memberships: DataFrame, tenant_id: str) -> DataFrame:
    return of_tenant(memberships, tenant_id).join(users, F.col("user_id") == F.col("id")).select("id", "name", "role").orderBy("name", "id")


def page(rows: DataFrame, before: int | None = None, limit: int = 50, most: int = 500, key: str = "seq") -> DataFrame:
    """A keyset page, newest first, with has_more and next_cursor on each row."""
    size = max(1, min(limit, most))
    out = rows if before is None else rows.where(F.col(key) < before)
    out = out.orderBy(F.desc(key)).limit(size + 1)
    # At most ``most`` + 1 rows.
    w = Window.orderBy(F.desc(key))
    got = out.withColumn("n", F.row_number().over(w)).withColumn("more", F.max("n").over(Window.partitionBy(F.lit(1))) > size)
    kept = got.where(F.col("n") <= size)
    return kept.withColumn("next_cursor", F.when(F.col("more"), F.min(key).over(Window.partitionBy(F.lit(1))))).drop("n", "more")


def parse_day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def check_window(source_a: str, source_b: str, start: str, end: str) -> None:
    """A run needs two different sources and a window that does not end before it starts."""
    if source_a == source_b:
        raise ValueError("a run needs two different sources")
    if parse_day(end) < parse_day(start):
        raise ValueError("the window ends before it starts")


def window_problem(source_a: Column, source_b: Column, start: Column, end: Column) -> Column:
    """The same for columns of requested runs: "sources", "from", "to", "window" or null."""
    return (
        F.when(source_a == source_b, "sources").when(F.try_to_date(start, "yyyy-MM-dd").isNull(), "from").when(F.try_to_date(end, "yyyy-MM-dd").isNull(), "to").when(end < start, "window")
    )


def by_text_id(rows: DataFrame) -> DataFrame:
    """A run's numbered rows with ``place``, their place by the id as text."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("id")))


def sort_state(state: tuple[str, str] | None, column: str) -> tuple[str, str] | None:
    """The order of a listing after a click on ``column``: ascending, then descending, then none; another column starts anew."""
    if state is None or state[0] != column:
        return column, "asc"
    return (column, "desc") if state[1] == "asc" else None


def numbered(rows: DataFrame, state: tuple[str, str] | None, key: str) -> DataFrame:
    """``rows`` with ``place`` in the order of ``state`` (column, asc or desc; nulls last), ties and no order by ``key``.

    Rows are dealt out in ranges of the order; a range's first place is the
    number of rows before it.
    """
    order = [F.col(key).asc()]
    if state is not None:
        order.insert(0, F.col(state[0]).asc_nulls_last() if state[1] == "asc" else F.col(state[0]).desc_nulls_last())
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    # A row for each range.
    sizes = dealt.groupBy(part.alias("range")).agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.withColumn("range", part).join(before, "range").withColumn("place", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1).cast("int")).select(*rows.columns, "place")
