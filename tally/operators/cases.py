"""Exception cases as event logs: replay, four-eyes approval, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPROVERS = ("approver", "admin")


def may(role: Column, permission: str) -> Column:
    """Role check: approving needs an approver, user management and audit an admin, the rest anyone."""
    if permission == "approve":
        return role.isin(*APPROVERS)
    if permission in ("manage_users", "view_audit"):
        return role == "admin"
    return F.lit(True)


def numbered(events: DataFrame) -> DataFrame:
    """Events with ``seq`` from 1 in each case, by time and id."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy("at", "id")))


def append(log: DataFrame, events: DataFrame) -> DataFrame:
    """The rows that ``events`` (case_id, id, at, ...) add to a numbered ``log``, with ``seq`` behind each case's last.

    Events the log has already, by id, and repeats within the batch add
    nothing, so a batch that comes again is harmless. Of the log only the
    cases that the batch touches are looked at.
    """
    fresh = events.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")
    touched = log.select("case_id", "seq").join(fresh.select("case_id").distinct(), "case_id", "left_semi")
    heads = touched.groupBy("case_id").agg(F.max("seq").alias("head"))
    new = fresh.select(*events.columns).join(heads, "case_id", "left")
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("at", "id"))
    return new.withColumn("seq", (F.coalesce("head", F.lit(0)) + nth).cast("int")).select(*events.columns, "seq")


def replay(events: DataFrame) -> DataFrame:
    """(case_id, status, assignee_id, requester_id, applied, refused, first_refused, reason) per case.

    Events (case_id, seq, kind, actor_id, role, assignee_id) are applied in
    the order of seq; one that its state does not allow is refused and changes
    nothing. A case's events stream by in order: a task holds the state of one
    case, not its log.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, s = _NONE, {}
        for batch in batches:
            out = []
            for case_id, seq, *event in batch.itertuples(index=False, name=None):
                case_id = None if pd.isna(case_id) else case_id
                if case is _NONE or case_id != case:
                    if case is not _NONE:
                        out.append((case, *s.values()))
                    case, s = case_id, {"status": "open", "assignee_id": None, "requester_id": None, "applied": 0, "refused": 0, "first_refused": None, "reason": None}
                _apply(s, None if pd.isna(seq) else int(seq), *(None if pd.isna(x) else x for x in event))
            yield _states(out)
        if case is not _NONE:
            yield _states([(case, *s.values())])

    case_type = events.schema["case_id"].dataType.simpleString()
    rows = events.select("case_id", F.col("seq").cast("int").alias("seq"), "kind", "actor_id", "role", "assignee_id")
    rows = rows.repartition("case_id").sortWithinPartitions(*rows.columns)
    schema = f"case_id {case_type}, status string, assignee_id string, requester_id string, applied int, refused int, first_refused int, reason string"
    return rows.mapInPandas(fold, schema)


#: Stands for no case, as a case id may be null.
_NONE = object()


def _states(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["case_id", "status", "assignee_id", "requester_id", "applied", "refused", "first_refused", "reason"], dtype=object)


def _apply(s: dict, seq: int | None, kind: str | None, actor_id: str | None, role: str | None, assignee_id: str | None) -> None:
    """Applies one event to a case's state, or counts it as refused."""
    status, problem = s["status"], None
    if kind == "approval_requested" and status not in ("open", "investigating"):
        problem = "not_requestable"
    elif kind in ("approved", "rejected") and status != "pending_approval":
        problem = "not_pending"
    elif kind == "approved" and role not in APPROVERS:
        problem = "role"
    elif kind == "approved" and s["requester_id"] is None:
        problem = "no_request"
    elif kind == "approved" and s["requester_id"] == actor_id:
        problem = "maker"
    if problem:
        s["refused"] += 1
        s["first_refused"] = seq if s["first_refused"] is None else s["first_refused"]
        s["reason"] = s["reason"] or problem
        return
    s["applied"] += 1
    if kind == "assignment" and status == "open":
        s["status"], s["assignee_id"] = "investigating", assignee_id
    elif kind == "rejected":
        s["status"] = "investigating"
    elif kind == "approval_requested":
        s["status"], s["requester_id"] = "pending_approval", actor_id
    elif kind == "approved":
        s["status"] = "resolved"


def assign(breaks: DataFrame, assignments: DataFrame, memberships: DataFrame) -> DataFrame:
    """(break columns, assigned): a bulk assignment (break_id, assignee_id); only members of the tenant are taken.

    The assignee is always set; an open break becomes investigating. Where a
    break is named more than once, the assignee of the smallest id counts.
    """
    one = assignments.groupBy("break_id").agg(F.min("assignee_id").alias("new_assignee"))
    known = memberships.select("tenant_id", F.col("user_id").alias("new_assignee")).distinct().withColumn("member", F.lit(True))
    j = breaks.join(one, breaks["id"] == one["break_id"], "left").drop("break_id").join(known, ["tenant_id", "new_assignee"], "left")
    ok = F.coalesce("member", F.lit(False))
    j = j.withColumn("assigned", ok)
    j = j.withColumn("assignee_id", F.when(ok, F.col("new_assignee")).otherwise(F.col("assignee_id")))
    j = j.withColumn("status", F.when(ok & (F.col("status") == "open"), "investigating").otherwise(F.col("status")))
    return j.select(*breaks.columns, "assigned")


def lockout_seconds(failures: Column) -> Column:
    """Seconds an account is locked after so many failures in a row: none below 5, then doubling to 60 * 2**10."""
    return F.when(failures < 5, 0).otherwise(F.lit(60) * F.pow(F.lit(2), F.least(failures - 5, F.lit(10)))).cast("bigint")


def failure_runs(logins: DataFrame) -> DataFrame:
    """(user_id, at, failures, locked_s) for each failed login (user_id, at, id, ok): failures since the last success."""
    order = Window.partitionBy("user_id").orderBy("at", "id")
    run = F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("at", "id"))
    start = F.max(F.col("ok").cast("int")).over(Window.partitionBy("user_id", "run"))
    counted = logins.withColumn("run", run).withColumn("n", n).withColumn("start", start).where(~F.col("ok"))
    failures = (F.col("n") - F.col("start")).cast("int")
    return counted.select("user_id", "at", "id", failures.alias("failures"), lockout_seconds(failures).alias("locked_s"))
