from tally import plans
from tally.plans.tpch import sides

SF = "/root/testdata/sf0.001"


def test_every_break_is_offered_the_best_rows_of_its_tenant(spark):
    known = plans.queries()
    a, b = sides(spark, SF)
    rows = {r.id: r for r in a.unionByName(b).collect()}
    breaks = [r.txn_id for r in known["match_breaks"](spark, SF).collect()]
    got = {}
    for r in known["suggest_top3"](spark, SF).orderBy("break_txn", "rank").collect():
        got.setdefault(r.break_txn, []).append((r.txn_id, r.score))
    assert set(got) <= set(breaks) and len({rows[i].run_id for i in got}) > 1

    def score(x, y):
        amount = min(1.0, max(0.0, 1 - abs(x.amount_minor - y.amount_minor) / max(x.amount_minor, 1)))
        day = max(0.0, 1 - abs((x.value_date - y.value_date).days) / 30)
        ref = 1.0 if x.external_ref == y.external_ref else 0.0
        if x.counterparty_account and y.counterparty_account:
            return 0.5 * amount + 0.25 * day + 0.1 * ref + 0.15 * (x.counterparty_account == y.counterparty_account)
        return 0.6 * amount + 0.3 * day + 0.1 * ref

    for i in breaks:
        x = rows[i]
        scores = {j: score(x, y) for j, y in rows.items() if j != i and (y.tenant_id, y.direction, y.currency) == (x.tenant_id, x.direction, x.currency)}
        best = sorted((s for s in scores.values() if s >= 0.55), reverse=True)[:3]
        mine = got.get(i, [])
        assert len(mine) == len(best) and all(abs(s - t) < 0.0051 and abs(scores[j] - s) < 0.0051 for (j, s), t in zip(mine, best))
