import random

from pyspark.sql import functions as F

import __spark_entry__
from tally import plans
from tally.operators import match
from tally.plans.tpch import by_run, sides
from tests.test_match import SCHEMA, brute

SF = "/root/testdata/sf0.001"


def test_each_month_is_a_run_equal_to_the_serial_walk(spark):
    rng = random.Random(11)
    months = ["2026-04", "2026-05", "2026-06"]

    def side(prefix):
        return [
            {"id": f"{prefix}{k:03d}", "external_ref": f"R-{prefix}{k}", "value_date": f"{months[k % 3]}-{rng.randint(1, 27):02d}", "amount_minor": rng.choice([100, 105, 400, 9000, 10000]), "direction": rng.choice(["debit", "credit"]), "currency": "GBP"}
            for k in range(60)
        ]

    a, b = side("a"), side("b")
    dfs = [by_run(spark.createDataFrame([(r["id"], "s", r["external_ref"], r["value_date"], r["amount_minor"], r["direction"], r["currency"], None, None) for r in rows], SCHEMA).withColumn("value_date", F.to_date("value_date")).withColumn("tenant_id", F.lit("t"))) for rows in (a, b)]
    decisions, breaks = (df.collect() for df in match.reconcile(*dfs, by=("run_id",)))
    for m in months:
        mine = lambda rows: [r for r in rows if r["value_date"].startswith(m)]  # noqa: B023, E731
        got = {r.txn_ids[0]: r.txn_ids[1] for r in decisions if r.run_id == f"run-t-{m}"}
        assert got == brute(mine(a), mine(b)) and got
        left = sorted({r["id"] for r in mine(a) + mine(b)} - set(got) - set(got.values()))
        assert [r.txn_ids[0] for r in sorted((r for r in breaks if r.run_id == f"run-t-{m}"), key=lambda r: r.ordinal)] == left
        assert sorted(r.id for r in decisions if r.run_id == f"run-t-{m}") == sorted(f"md-run-t-{m}-{k}" for k in range(len(got)))


def test_every_row_of_every_month_is_decided_or_a_break(spark):
    a, b = sides(spark, SF)
    assert a.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    stats = __spark_entry__.entry(spark).collect()
    assert sum(2 * (r.matched + r.partial + r.duplicate) + r.unmatched for r in stats) == a.count() + b.count()
    assert len(stats) == a.unionByName(b).select("run_id").distinct().count()
    tenant = {r.id: r.tenant_id for r in a.unionByName(b).select("id", "tenant_id").collect()}
    known = plans.queries()
    assert all(tenant[r.first_txn] == tenant[r.second_txn] for r in known["match_decisions"](spark, SF).collect())
    assert all(tenant[r.break_txn] == tenant[r.txn_id] for r in known["suggest_top3"](spark, SF).collect())


def test_equal_rows_of_two_tenants_never_meet(spark):
    row = lambda i, tenant: (i, "s", "R-1", "2026-05-02", 500, "debit", "GBP", None, None, tenant)
    a, b = (
        by_run(spark.createDataFrame([row(f"{side}1", t1), row(f"{side}2", t2)], SCHEMA + ", tenant_id string").withColumn("value_date", F.to_date("value_date")))
        for side, t1, t2 in (("a", "x", "y"), ("b", "y", "z"))
    )
    decisions, breaks = match.reconcile(a, b, by=("run_id",))
    assert [r.txn_ids for r in decisions.collect()] == [["a2", "b1"]]
    assert sorted(r.txn_ids[0] for r in breaks.collect()) == ["a1", "b2"]
    assert match.suggest(a.where("id = 'a1'"), a.unionByName(b), by=("tenant_id",)).count() == 0
