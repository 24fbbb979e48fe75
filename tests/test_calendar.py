"""The nearest calendar entry is found without pairing asks and entries."""

import random
import time

from wordloom.operators import ideas as idl


def _most_rows(spark):
    """The most rows that a step of the last query made."""
    time.sleep(1)  # the listener is behind
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = store.executionMetrics(last.executionId())
    named = [last.metrics().apply(i) for i in range(last.metrics().size())]
    rows = [values.get(m.accumulatorId()) for m in named if m.name() == "number of output rows"]
    return max(int(v.get().replace(",", "")) for v in rows if v.isDefined())


def test_like_all_pairs(spark):
    rng = random.Random(3)
    asks = [(i, rng.randrange(-500, 4000)) for i in range(150)] + [(7, 100), (7, 3900), (900, None), (901, 10**6)]
    entries = [(i, rng.choice([rng.randrange(-900, 900), rng.randrange(2500, 2600), 3999])) for i in range(60)] + [(77, None)]
    got = idl.nearest_entry(
        spark.createDataFrame(asks, "ask bigint, at bigint"), spark.createDataFrame(entries, "entry bigint, at bigint"), 90
    ).collect()
    best = {}
    for ask, at in asks:
        for entry, e_at in entries:
            if at is not None and e_at is not None and abs(e_at - at) <= 90:
                best[ask] = min(best.get(ask, (10**9, 0)), (abs(e_at - at), entry))
    want = [(ask, *(best[ask][::-1] if ask in best else (None, None))) for ask, _ in asks]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_row_per_pair(spark):
    asks = spark.range(3000).selectExpr("id AS ask", "id % 100 AS at")
    entries = spark.range(3000).selectExpr("id AS entry", "id % 7 * 20 AS at")
    got = {r.ask: (r.entry, r.distance_s) for r in idl.nearest_entry(asks, entries, 900).collect()}
    assert got[2950] == (2, 10) and got[41] == (2, 1) and len(got) == 3000
    assert _most_rows(spark) <= 3000
