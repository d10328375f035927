import random

import pytest
from pyspark.sql import functions as F

from deltascope.functions.text import compact_key, similarity
from deltascope.operators import categories as cat


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def sequential(counts):
    """The rule as it stands, one value after the other."""
    key = {v: "".join(c for c in v.lower() if c.isalnum()) for v in counts}
    gone, out = set(), {}
    score = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    for v in sorted(counts, key=lambda v: (counts[v], v)):
        if len(key[v]) < 4:
            continue
        ranked = sorted(
            ((-score(key[v], key[c]), c) for c in counts if c != v and c not in gone and len(key[c]) >= 4 and abs(len(key[c]) - len(key[v])) <= 0.2 * max(len(key[c]), len(key[v])) and (counts[c] > counts[v] or (counts[c] == counts[v] and len(key[c]) >= len(key[v])))),
        )
        if not ranked:
            continue
        top, name = -ranked[0][0], ranked[0][1]
        if (top >= 0.93 or (len(key[v]) >= 8 and len(name) >= 8 and top >= 0.88)) and (len(ranked) == 1 or top + ranked[1][0] >= 0.04):
            gone.add(v)
            out[v] = name
    return out


def made_up(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(60)] + ["co", "ab"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(n // 3)]
    counts = {}
    for _ in range(n):
        v = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            i = r.randrange(len(v))
            v = r.choice([v[:i] + v[i + 1 :], v[:i] + r.choice("aeixz") + v[i:], v[:i] + r.choice("aeixz") + v[i + 1 :]]) or "v"
        counts[v.strip() or "v"] = r.choice([1, 1, 1, 2, 2, 5])
    return counts


@pytest.mark.parametrize("seed,n", [(1, 600), (2, 900)])
def test_rounds_equal_the_sequential_rule(spark, seed, n):
    counts = made_up(seed, n)
    df = spark.createDataFrame([("c", v, k) for v, k in counts.items()], "column string, value string, n long")
    none = spark.createDataFrame([], "column string, value string, replacement string, reason string")
    got = {r.value: r.replacement for r in cat.fuzzy_replacements(df, none, None).collect()}
    want = sequential(counts)
    assert len(want) > 100 and got == want
    assert cat.fuzzy_replacements(df, none).count() == 0  # more values than the rule's limit


def test_index_join_finds_all_pairs(spark):
    counts = made_up(7, 700)
    df = spark.createDataFrame([("c", v, k) for v, k in counts.items()], "column string, value string, n long").withColumn("key", compact_key(F.col("value"))).where("length(key) >= 4")
    both = df.select(F.col("value").alias("a"), F.col("key").alias("ka")).join(df.select(F.col("value").alias("b"), F.col("key").alias("kb")), F.col("a") < F.col("b"))
    want = {frozenset((r.a, r.b)) for r in both.where(similarity(F.col("ka"), F.col("kb")) >= 0.84).collect()}
    rows = cat.close_pairs(df, 0.84).collect()
    assert len(want) > 200 and {frozenset((r.x_value, r.y_value)) for r in rows} == want and len(rows) == len(want)
