import pytest

from tally import plans
from tally.plans import listing
from tally.plans.tpch import frame

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def rows_of(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def test_tables_hold_a_row_for_every_order_or_customer(spark):
    orders, customers = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "customer"))
    for part, n in ((listing.BREAKS, orders), (listing.RUNS, orders), (listing.USERS, customers), (listing.MEMBERSHIPS, customers)):
        assert frame(spark, SF, part).count() == n


@pytest.mark.parametrize("name", [*listing.QUERIES, "source_patch", "my_tenants", "wire_transactions", "ingest_dedupe", "tri_state_sort", "display_money", "request_problems", "bulk_assign", "membership_backfill", "match_run_stats", "suggest_top3"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(plans.oracles()[name])
    got = plans.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    want = rows_of(want.select(*got.columns).fetchall())
    assert rows_of(got.collect()) == want and want


def test_run_detail_with_an_id_that_all_name(spark):
    from tally.operators import listing

    decisions = spark.createDataFrame([(f"d{k}", ["hot", f"t{k}", "none", None]) for k in range(300)], "id string, txn_ids array<string>")
    txns = spark.createDataFrame([("hot", "H", 5)] + [(f"t{k}", f"R{k}", k) for k in range(0, 300, 2)], "id string, external_ref string, amount_minor bigint")
    got = {r.id: [(t.txn_id, t.external_ref, t.amount_minor) for t in r.txns] for r in listing.run_detail(decisions, txns).collect()}
    assert got == {f"d{k}": [("hot", "H", 5), (f"t{k}", None if k % 2 else f"R{k}", None if k % 2 else k), ("none", None, None), (None, None, None)] for k in range(300)}
    # Only ids that few decisions name go through the join by shuffle.
    plan = listing.run_detail(decisions, txns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= 3 and "hot" in plan
