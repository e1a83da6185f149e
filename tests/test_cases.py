import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tally.operators import cases
from tally.plans import trail

SCHEMA = "case_id string, seq int, kind string, actor_id string, role string, assignee_id string"


def brute(log):
    """(status, assignee, requester, applied, refused, first_refused, reason) of one case's events in order."""
    status, assignee, requester, applied, bad = "open", None, None, 0, []
    for _, seq, kind, actor, role, new in log:
        checks = [
            ("not_requestable", kind == "approval_requested" and status not in ("open", "investigating")),
            ("not_pending", kind in ("approved", "rejected") and status != "pending_approval"),
            ("role", kind == "approved" and role not in ("approver", "admin")),
            ("no_request", kind == "approved" and requester is None),
            ("maker", kind == "approved" and requester is not None and requester == actor),
        ]
        why = next((name for name, hit in checks if hit), None)
        if why:
            bad.append((seq, why))
            continue
        applied += 1
        if kind == "assignment" and status == "open":
            assignee = new
        if kind == "approval_requested":
            requester = actor
        status = {"approval_requested": "pending_approval", "approved": "resolved", "rejected": "investigating"}.get(kind, "investigating" if kind == "assignment" and status == "open" else status)
    first = bad[0] if bad else (None, None)
    return (status, assignee, requester, applied, len(bad), *first)


def test_a_hot_case_streams_through_in_many_batches(spark):
    rng = random.Random(4)
    kinds = ["comment", "assignment", "approval_requested", "approved", "rejected", None]
    logs = {f"case-{c}": [(f"case-{c}", s + 1, rng.choice(kinds), rng.choice(["u1", "u2", None]), rng.choice(["operator", "approver", "admin", None]), rng.choice(["u3", None])) for s in range(n)] for c, n in enumerate([2000, *[1 + k % 7 for k in range(60)]])}
    logs[None] = [(None, 1, "assignment", "u1", "admin", "u3")]
    rows = [r for log in logs.values() for r in log]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        replayed = cases.replay(spark.createDataFrame(rows, SCHEMA))
        got = {r.case_id: tuple(r)[1:] for r in replayed.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {c: brute(log) for c, log in logs.items()}
    assert "collect_list" not in replayed._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_append_takes_timestamps_with_and_without_a_zone(spark, tmp_path, kind):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=97 * (k // 2)), k % 7, "view", 1.0, "{}") for k in range(300)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast(kind)).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in trail.QUERIES["case_append"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.execute(trail.ORACLES["case_append"]).fetchall()) and len(got) == 300
