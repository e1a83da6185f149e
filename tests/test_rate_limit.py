import random
from datetime import datetime, timedelta

import pytest

from tally import plans
from tally.streaming import jobs


def test_buckets_equal_a_walk_and_null_keys_have_one(spark):
    rng = random.Random(9)
    start = datetime(2026, 1, 1)
    rows = [(rng.choice(["a", "b", None]), start + timedelta(seconds=rng.randint(0, 300)), k) for k in range(400)]
    want, state = {}, {}
    for key, at, k in sorted(rows, key=lambda r: (r[1], r[2])):
        tokens, last = state.get(key, (10.0, at))
        tokens = min(10.0, tokens + (at - last).total_seconds() * 10 / 60)
        want[k] = tokens >= 1
        state[key] = (tokens - want[k], at)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = jobs.token_bucket_batch(spark.createDataFrame(rows, "key string, at timestamp, id bigint")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {r.id: r.allowed for r in got} == want
    assert {r.id for r in got if r.key is None} == {k for key, _, k in rows if key is None}


def test_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = {(k, i): ok for k, i, ok in db.sql(f"SELECT key, id, allowed FROM ({plans.oracles()['rate_limit']}) q").fetchall()}
    got = {(r.key, r.id): r.allowed for r in plans.queries()["rate_limit"](spark, sf_dir).collect()}
    assert got == want and {True, False} == set(got.values())
