"""Streams with repeated batches, late files and rows, and idle keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tally.operators import audit, cases
from tally.sources import statements as st
from tally.streaming import case_status, jobs
from tests.test_cases import SCHEMA as EVENT, brute

MAPPING = {"columns": {"external_ref": "Ref", "value_date": "Date"}, "date_format": "%Y-%m-%d", "amount": {"signed": "Amount"}}


def csv_file(folder, name, refs):
    (folder / name).write_text("Ref,Date,Amount\n" + "".join(f"{r},2026-05-0{1 + k % 9},{k + 1}.50\n" for k, r in enumerate(refs)))


def test_ingest_with_a_repeated_batch_a_late_file_and_another_source(spark, tmp_path):
    inbox, table = tmp_path / "inbox", str(tmp_path / "table")
    inbox.mkdir()
    parse = lambda files: st.parse_csv(files, MAPPING)
    start = lambda: jobs.ingest_stream(spark, str(inbox), table, str(tmp_path / "checkpoint"), parse, "t", "src-1", "GBP").awaitTermination()
    stored = lambda: sorted((r.source_id, r.external_ref) for r in spark.read.parquet(table).collect())
    csv_file(inbox, "one.csv", ["A", "B"])
    start()
    csv_file(inbox, "two.csv", ["C", "D"])
    csv_file(inbox, "late.csv", ["B", "E"])  # B is stored: the file is refused whole
    start()
    assert stored() == [("src-1", r) for r in "ABCD"]
    # The second batch once more, as after a failure between its write and its commit.
    files = spark.read.format("binaryFile").load([str(inbox / "two.csv"), str(inbox / "late.csv")])
    jobs.ingest_batch(table, parse, "t", "src-1", "GBP")(files, 1)
    assert stored() == [("src-1", r) for r in "ABCD"]
    # Another source may use the same references, and reads none of the first one's.
    jobs.ingest_batch(table, parse, "t", "src-2", "GBP")(files, 0)
    assert stored() == [("src-1", r) for r in "ABCD"] + [("src-2", r) for r in "BCDE"]


def test_token_bucket_stream_equals_the_batch_form_and_forgets_idle_keys(spark, tmp_path):
    rng, start = random.Random(5), dt.datetime(2026, 5, 1)
    rows = [(rng.choice(["a", "b"]), start + dt.timedelta(seconds=30 * k + rng.randint(0, 20)), k) for k in range(120)]
    rows += [("idle", start, 1000), ("idle", start, 1001), ("idle", start + dt.timedelta(hours=10), 1002)]
    rows.sort(key=lambda r: (r[1], r[2]))
    df = spark.createDataFrame(rows, "key string, at timestamp, id bigint")
    source = str(tmp_path / "requests")
    for k in range(4):
        spark.createDataFrame(rows[k * 31 : (k + 1) * 31], df.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    judged = jobs.token_bucket(stream, capacity=3, refill=1 / 100, delay="1 minute")
    query = judged.writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.key, r.id, r.allowed) for r in jobs.token_bucket_batch(df, capacity=3, refill=1 / 100).collect()}
    assert {(r.key, r.id, r.allowed) for r in spark.table("judged").collect()} == want
    # The watermark passed the time at which the buckets of the first stretch were full again.
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] < 3 and sum(s["numRowsRemoved"] for s in state) > 0


def chained(spark, n=30):
    rows = [(f"tenant-{k % 3}", f"2026-05-01T00:00:{k:02d}.000000Z", "u", audit.KINDS[k % 5], "{}", k) for k in range(n)]
    return audit.append(spark.createDataFrame(rows, "tenant_id string, at string, actor_id string, kind string, payload string, order bigint"))


def test_an_anchor_that_is_taken_again_adds_nothing(spark, tmp_path):
    log, anchors = str(tmp_path / "log"), str(tmp_path / "anchors")
    chained(spark).write.parquet(f"{log}/batch=-1")
    put = jobs.anchor_batch(log, anchors)
    tick = lambda k: spark.createDataFrame([(dt.datetime(2026, 5, 2, k), k)], "timestamp timestamp, value bigint")
    put(tick(1), 0)
    put(tick(2), 1)
    read = lambda p: sorted(map(tuple, spark.read.parquet(p).select("hash").collect()))
    before = read(log), read(anchors)
    put(tick(2), 1)
    assert (read(log), read(anchors)) == before and len(before[0]) == 30 + 6 and len(before[1]) == 2
    whole = spark.read.schema(f"{jobs.AUDIT}, batch long").parquet(log)
    taken = spark.read.schema(f"{jobs._ANCHOR}, batch long").parquet(anchors)
    assert audit.verify_anchors(taken).count() == 0 and {r.status for r in audit.verify_whole(whole, taken).collect()} == {"valid"}
    assert audit.verify_anchors(taken.withColumn("at", F.lit("x"))).count() == 2


def test_anchors_come_at_their_trigger(spark, tmp_path):
    log, anchors = str(tmp_path / "log"), str(tmp_path / "anchors")
    chained(spark, 6).write.parquet(f"{log}/batch=-1")
    query = jobs.anchor_stream(spark, log, anchors, str(tmp_path / "checkpoint"), every="1 second")
    try:
        for _ in range(60):
            if query.lastProgress and query.lastProgress["batchId"] >= 2:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    taken = spark.read.schema(f"{jobs._ANCHOR}, batch long").parquet(anchors)
    assert taken.count() >= 2 and audit.verify_anchors(taken).count() == 0


def test_faults_in_ranges_orders_and_stretches(spark):
    log = chained(spark, 300)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = lambda df, **o: {r.tenant_id: (r.checked, r.bad_seq, r.reason) for r in audit.verify(df, **o).collect()}
        assert found(log) == {f"tenant-{t}": (100, None, None) for t in range(3)}
        one = F.col("tenant_id") == "tenant-1"
        for seq in (1, 2, 40, 41, 100):
            hit = one & (F.col("seq") == seq)
            assert found(log.withColumn("payload", F.when(hit, "x").otherwise(F.col("payload"))))["tenant-1"] == (100, seq, "tampered")
            gone = found(log.where(~hit))["tenant-1"]
            assert gone == ((99, None, None) if seq in (1, 100) else (99, seq + 1, "missing"))
            twice = found(log.unionByName(log.where(hit)))["tenant-1"]
            assert twice == (101, seq, "reordered")
        assert found(log.withColumn("hash", F.when(one & (F.col("seq") == 9), F.lit(audit.GENESIS)).otherwise(F.col("hash"))))["tenant-1"] == (100, 9, "tampered")
        late = log.withColumn("arrival", F.when(one & (F.col("seq") == 7), F.lit(50.5)).otherwise(F.col("seq")) * 2)
        assert found(late, arrival="arrival")["tenant-1"] == (100, 8, "missing")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_case_stream_with_late_and_replayed_events(spark, tmp_path):
    rng = random.Random(9)
    kinds = ["comment", "assignment", "approval_requested", "approved", "rejected"]
    logs = {f"c{c}": [(f"c{c}", s + 1, rng.choice(kinds), rng.choice(["u1", "u2"]), rng.choice(["operator", "approver", "admin"]), rng.choice(["u3", None])) for s in range(n)] for c, n in enumerate([150, 1, 2, 9, 30])}
    rows = [r for log in logs.values() for r in log]
    rng.shuffle(rows)
    source, table = str(tmp_path / "log"), str(tmp_path / "status")
    third = len(rows) // 3
    parts = [rows[:third] + [(None, 1, "comment", "u1", "admin", None)], rows[third : 2 * third] + rows[:20], rows[2 * third :] + rows[third : third + 20]]

    def go(k):
        spark.createDataFrame(parts[k], EVENT).coalesce(1).write.mode("append").parquet(source)
        case_status.run_to_table(spark.readStream.schema(case_status.EVENT).option("maxFilesPerTrigger", 1).parquet(source), table, str(tmp_path / "checkpoint"))
        return {r.case_id: tuple(r)[1:] for r in case_status.latest(spark, table).collect()}

    first = go(0)
    assert first["c0"][-1] > 0  # events wait for those before them
    go(1)
    assert go(2) == {c: (*brute(log), len(log), 0) for c, log in logs.items()}


def test_appending_to_a_case_log_twice_numbers_once(spark):
    rows = [(f"c{k % 3}", k, k // 2) for k in range(40)]
    df = spark.createDataFrame(rows, "case_id string, id bigint, at bigint")
    want = {(r.case_id, r.id, r.seq) for r in cases.numbered(df).collect()}
    log = cases.append(cases.numbered(df.limit(0)), df.where("id < 20"))
    for part in ("id between 10 and 29", "id < 30", "id >= 25"):
        log = log.unionByName(cases.append(log, df.where(part).unionByName(df.where(part))))
    assert {(r.case_id, r.id, r.seq) for r in log.collect()} == want


def test_long_logs_are_chained_in_stretches(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(f"t{k % 3}" if k > 60 else "t0", f"at{k}", "u", "auth.logout", "{}", k) for k in range(100)]
    events = spark.createDataFrame(rows, "tenant_id string, at string, actor_id string, kind string, payload string, order bigint")
    heads = audit.heads_of(audit.append(events.where("order < 7")))
    seen = lambda log: sorted(map(tuple, log.select("tenant_id", "seq", "at", F.hex("hash")).collect()))
    whole = seen(audit.append(events, heads))
    monkeypatch.setattr(audit, "STRETCH", 25)
    log = audit.append(events, heads)
    assert seen(log) == whole
    # No stretch is much longer than it should be: each was written as one file a tenant.
    assert log.groupBy("tenant_id", F.input_file_name()).count().agg(F.max("count")).first()[0] <= 30
    assert {r.status for r in audit.verify(audit.append(events)).collect()} == {"valid"}


def test_waiting_events_cost_no_store_call_each():
    import pandas as pd

    calls = []

    class State:
        def __init__(self, many):
            self.kept, self.many = [], many

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: bool(self.kept), "get": lambda: iter(list(self.kept)) if self.many else self.kept[0], "update": lambda v: self.kept.__setitem__(slice(None), [v]),
                    "put": lambda v: self.kept.__setitem__(slice(None), v), "appendList": self.kept.extend, "clear": self.kept.clear}[name]

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State(False)

        def getListState(self, *_):  # noqa: N802
            return State(True)

    case = case_status.CaseStatus()
    case.init(Handle())
    event = lambda seq: (seq, "comment", "u", "operator", None)
    batches = ([*range(301, 601)], [*range(2, 302)], [1, 1, 5])
    for seqs in batches:
        rows = pd.DataFrame([event(s) for s in seqs], columns=["seq", "kind", "actor_id", "role", "assignee_id"])
        last = next(iter(case.handleInputRows(("c",), iter([rows]), None)))
    assert (last.applied[0], last.last_seq[0], last.waiting[0]) == (600, 600, 0)
    assert len(calls) <= 5 * len(batches)
