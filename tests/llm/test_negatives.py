import math
import random

import numpy as np
import pytest

from deltascope.llm import negatives

SCHEMA = "uid long, vec_id long, embedding array<float>, label int, score string, windows int, q string"


def brute(rows, every):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and whole(v):
            moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            kept.append((i, vec_id, moved, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for me, anchor, label, a in kept:
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, q)), i, other) for n, i, other, q in kept if n != me]
        for p, positive in sorted(((s, i) for s, i, o in scored if o == label), key=lambda x: order(*x))[:5]:
            found = sorted(((s, i) for s, i, o in scored if o != label and 30 * p <= 100 * s <= 90 * p), key=lambda x: order(*x))
            out += [(anchor, positive, r + 1, i, p, s) for r, (s, i) in enumerate(found[:10])]
    return sorted(out, key=str)


def made_up(seed, n=400, width=12):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = [x * 0.5 + r.gauss(0, 0.4) for x in c]
        rows.append((i, v, r.randrange(10) if r.random() < 0.5 else 3))
    rows += [(1000 + i, rows[5][1], r.randrange(3)) for i in range(120)]  # copies
    rows += [(20, [0.0] * width, 1), (40, [0.0] * width, 2), (41, [0.0] * width, 1), (60, [-x for x in rows[5][1]], 3), (80, [0.25], 3), (81, [], 4), (100, [], 3)]
    rows += [(7, None, 1), (0, rows[1][1], None), (140, [None] * width, 2), (160, [float("nan")] * width, 2), (180, [float("inf")] + [0.0] * 3, 2), (None, rows[2][1], 2), (None, rows[2][1], 5)]
    return rows + [rows[40], rows[40], rows[41]]


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 100)])
def test_negatives_equal_brute_force(spark, seed, block):
    rows = made_up(seed)
    df = spark.createDataFrame([(5, i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(df, 20, block).collect()), key=str)
    want = brute(rows, 20)
    assert len(want) > 500 and got == want


def test_few_rows_and_none(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, 0, [1.0], 1, "", 1, "")], SCHEMA)
    assert negatives.mine(one).count() == 0
    three = spark.createDataFrame([(1, 0, [1.0], 0, "", 1, ""), (1, 1, [1.0], 1, "", 1, ""), (1, 2, [0.5], 2, "", 1, "")], SCHEMA)
    assert [tuple(r) for r in negatives.mine(three).collect()] == [(0, 1, 1, 2, 65536, 32768)]


@pytest.mark.parametrize("exact", [np.float64, np.int64])
def test_index_finds_all_and_touches_less(exact):
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 40, (3000, 48)) * np.linspace(2, 0.2, 48))
    a = np.floor(r.normal(0, 40, (70, 48)) * np.linspace(2, 0.2, 48))
    full = a @ x.T
    for share in (0.7, 0.4, 0.1, 0.0):
        t = np.quantile(full, 1 - (1 - share) * 0.02, axis=1) if share else np.zeros(70)
        index = negatives.BlockIndex(x, float(np.sqrt((a**2).sum(axis=1)).max()), float(t.min()))
        i, j, score = index.search(a, t, exact)
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(full >= t[:, None]))) and (score == full[i, j]).all()
        assert index.touched <= a.shape[0] * x.size
        if share >= 0.4:
            assert index.touched < 0.8 * a.shape[0] * x.size


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="fit a long"):
        negatives.mine(spark.createDataFrame([(1, 0, [1e30], 1, "", 1, "")], SCHEMA))
