import pytest
from pyspark.sql import functions as F

from tally.operators import match, seed
from tally.sources import registry
from tests.test_match import ACME_1, ACME_1B, ACME_6, ACME_6B, frame


def golden(spark):
    """The seeded windows of one tenant as store tables."""
    a, b = (frame(spark, x).unionByName(frame(spark, y)).withColumn("run_id", F.when(F.col("value_date") < "2026-05-10", "run-1").otherwise("run-6")) for x, y in ((ACME_1, ACME_6), (ACME_1B, ACME_6B)))
    decisions, breaks = match.reconcile(a, b, by=("run_id",))
    stats = match.run_stats(decisions, breaks, ("run_id",))
    tenant = F.lit("tenant-acme").alias("tenant_id")
    txns = a.withColumn("source_id", F.lit("bank")).unionByName(b.withColumn("source_id", F.lit("ledger")))
    return {
        "tenants": spark.createDataFrame([("tenant-acme",)], "id string"),
        "sources": spark.createDataFrame([("bank", "tenant-acme"), ("ledger", "tenant-acme")], "id string, tenant_id string"),
        "transactions": txns.select("*", tenant).drop("source"),
        "runs": stats.withColumnRenamed("run_id", "id").select("*", tenant),
        "decisions": decisions.select("*", tenant),
        "breaks": breaks.select("*", tenant),
    }


def test_a_store_that_is_loaded_twice_holds_the_same(spark, tmp_path):
    root, tables = str(tmp_path / "store"), golden(spark)
    held = []
    for _ in range(2):
        seed.load(spark, root, tables)
        held.append({n: sorted(map(str, seed.read(spark, root, n, df).collect())) for n, df in tables.items()})
    assert held[0] == held[1] and all(held[0].values())
    # The statistics of the seeded runs.
    runs = {r.id: (r.matched, r.partial, r.duplicate, r.break_count, r.match_rate_pct, r.value_at_risk_minor) for r in seed.read(spark, root, "runs", tables["runs"]).collect()}
    assert runs == {"run-1": (3, 1, 0, 0, 75.0, 0), "run-6": (0, 0, 1, 4, 0.0, 490500)}
    stored = {n: seed.read(spark, root, n, df) for n, df in tables.items()}
    assert {r.n for r in seed.orphans(stored).collect()} == {0}
    lost = {**stored, "runs": stored["runs"].where("id <> 'run-6'"), "tenants": stored["tenants"].where("false")}
    found = {(r.table, r.column): r.n for r in seed.orphans(lost).collect()}
    assert found["breaks", "run_id"] == 4 and found["decisions", "run_id"] == 1 and found["sources", "tenant_id"] == 2

    other = stored["breaks"].withColumn("tenant_id", F.lit("tenant-other"))
    seed.replace_tenants(root, "breaks", other)
    seed.replace_tenants(root, "breaks", other.limit(1))
    assert {r.tenant_id: r["count"] for r in seed.read(spark, root, "breaks", tables["breaks"]).groupBy("tenant_id").count().collect()} == {"tenant-acme": 4, "tenant-other": 1}
    seed.reset(spark, root)
    assert not (tmp_path / "store" / "runs").exists()
    with pytest.raises(ValueError, match="no table odd"):
        seed.load(spark, root, {"odd": other})


def test_formats_check_their_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("r,2026-05-01,1.00\n")
    mapping = {"has_header": False, "columns": {"external_ref": 0, "value_date": 1}, "date_format": "%Y-%m-%d", "amount": {"signed": 2}}
    registry.register(spark, "mine", str(tmp_path), "csv", mapping=mapping)
    assert [tuple(r) for r in spark.sql("SELECT external_ref, amount_minor FROM mine WHERE direction = 'credit'").collect()] == [("r", 100)]
    assert spark.sql("SELECT * FROM mine_errors").count() == 0
    for fmt, options, words in (("odd", {}, "no statement format"), ("csv", {}, "needs the option mapping"), ("bai2", {"x": 1}, "no option x"), ("mt940", {"dialect": "z"}, "is one of")):
        with pytest.raises(ValueError, match=words):
            registry.read_statements(registry.files_of(spark, str(tmp_path)), fmt, **options)
