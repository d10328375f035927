import numpy as np
import pytest

from deltascope.sources.ranks import RankStore


@pytest.mark.parametrize("zone", [1, 7, 50])
def test_quartiles_of_batches(spark, tmp_path, zone):
    r = np.random.default_rng(zone)
    store, want = RankStore(spark, f"file://{tmp_path}/ranks", zone), {}
    assert store.quartiles().count() == 0
    for b, label in enumerate(("x", "y", "x2", "y")):  # the last takes the place of the second
        rows = [("a", float(v)) for v in r.normal(b, 1 + b, 60).round(1)] + [("same", 3.0)] * 9 + [("a", None)]
        rows += [("late", float(b))] if b > 1 else []
        store.add(spark.createDataFrame(rows, "column string, value double").repartition(3), label)
        want[label] = [x for x in rows if x[1] is not None]
    all_ = [x for rows in want.values() for x in rows]
    got = {q["column"]: (q.n, q.q1, q.q3) for q in store.quartiles().collect()}
    for c in ("a", "same", "late"):
        values = [v for n, v in all_ if n == c]
        assert got[c][0] == len(values) and np.allclose(got[c][1:], np.quantile(values, [0.25, 0.75])), c


def test_only_zones_in_the_bracket_are_read(spark, tmp_path):
    store = RankStore(spark, f"file://{tmp_path}/ranks", 100)
    for b in range(4):
        values = np.random.default_rng(b).normal(0, 1, 5000)
        store.add(spark.createDataFrame([("a", float(v)) for v in values], "column string, value double"), str(b))
    rows = store.looked_at(store.brackets())
    seen = rows.groupBy("rank").count().collect()
    print("of 20,000 values looked at, by rank:", {r.rank: r["count"] for r in seen})
    assert max(r["count"] for r in seen) < 3000
