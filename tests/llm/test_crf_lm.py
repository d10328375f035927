import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deltascope.llm import crf, keycounts, lm
from deltascope.llm.textarrays import slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "text string, doc_id long, score string, quality string, chunk string"


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    move, sizes = r.normal(size=(2, 2)), [4, 1, 3]
    of = np.repeat(np.arange(3), sizes)
    e = r.normal(size=len(of))
    a, b = crf.forward_backward(crf.Chain.of(of), e, move)
    got, at = crf.sigmoid(a + b), 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product([0, 1], repeat=n):
            w = math.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def crf_corpus(n=300):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        lines = ["The " + " ".join(r.choice(["river", "stone", "walks", "slowly", "under"]) + str(r.randrange(50)) for _ in range(12)) + "." for _ in range(r.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), " ".join(r.choice(["BUY!!", "###", "win$$$"]) for _ in range(40)))
        docs.append(("\n".join(lines), i, "c", "c", "c"))
        labels.append((i, int(i % 3 != 0), 0))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = crf_corpus()
    extra = [("", 1000, "", "", ""), (None, 1001, "", "", ""), ("word " * 30000, 1002, "", "", ""), docs[0], docs[1]]
    d = spark.createDataFrame(docs + extra, SCHEMA)
    y = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = crf.classify(d, y).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = {r.doc_id for r in crf.keep_good(d, y).collect()}
    assert kept == {r.doc_id for r in rows if r.score >= 0.5}


def test_held_out_labels_are_not_read(spark):
    docs, labels = crf_corpus(120)
    d = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in labels]
    a, b = (sorted((r.doc_id, r.score) for r in crf.classify(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([("a b", 1, "", "", "")], SCHEMA)
    assert [r.score for r in crf.classify(docs, none).collect()] == [0.5]
    assert crf.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def lm_corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "日本"]
    texts = [" ".join(r.choice(words[: r.randrange(2, 62)]) for _ in range(r.randrange(1, 80))) for _ in range(250)]
    return texts + ["", None, "\n \t", "UPPER upper Upper", texts[0], texts[0], "long word " * 5000]


@pytest.mark.parametrize("chunk, part_keys, fan", [(8 << 20, 6_000_000, 4096), (400, 6_000_000, 4096), (400, 300, 4096), (400, 300, 3)])
def test_lm_equals_brute_force(spark, monkeypatch, chunk, part_keys, fan):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(keycounts, "PART_KEYS", part_keys)
    monkeypatch.setattr(keycounts, "FAN", fan)
    texts = lm_corpus()
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame([(t, i, "", "", "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*WORD.findall((t or "").translate(lower)), "\n"] for i, t in enumerate(texts)}
    crc = {i: zlib.crc32(str(i).encode()) for i in tokens}
    train = [i for i in tokens if crc[i] % 5 != 1]

    def grams(t):
        """(u, v, w) of each token; a text's first has two ends before it."""
        return zip(["\n", "\n", *t], ["\n", *t], t)

    def counts(ids):
        c1, c2, c3 = Counter(), Counter(), Counter()
        for i in ids:
            for k, (u, v, w) in enumerate(grams(tokens[i])):
                c1[w] += 1
                c2[v, w] += 1
                c3[u, v, w] += 1
        context = Counter()
        for (u, v, _), k in c3.items():
            context[u, v] += k
        return c1, c2, c3, context

    def bucket(c):
        return min(c.bit_length(), lm.BUCKETS - 1)

    def parts(c, total, low, high, u, v, w):
        c1, c2, c3, context = c
        b2, b3 = bucket(c1[v]), bucket(context[u, v])
        p = low[b2] * [c2[v, w] / c1[v] if c1[v] else 0.0, c1[w] / total, 1 / (size + 1)]
        return b2, b3, np.append((1 - high[b3]) * p, high[b3] * c3[u, v, w] / context[u, v] if context[u, v] else 0.0)

    dev = [i for i in train if crc[i] // 5 % 20 == 0]
    held, full = counts(set(train) - set(dev)), counts(train)
    n, size, kept = sum(full[0].values()), len(full[0]), sum(held[0].values())
    low, high = np.tile([0.5, 0.4, 0.1], (lm.BUCKETS, 1)), np.full(lm.BUCKETS, 0.5)
    high[0] = 0.0
    for _ in range(lm.ROUNDS):
        s2, s3 = {}, {}
        for i in dev:
            for u, v, w in grams(tokens[i]):
                b2, b3, x = parts(held, kept, low, high, u, v, w)
                x = x / x.sum()
                s2[b2], s3[b3] = s2.get(b2, 0) + x[:3], s3.get(b3, 0) + np.array([x[:3].sum(), x[3]])
        for b in range(lm.BUCKETS):
            if b in s2:
                s = s2[b] + [0, 0, 1e-3]
                low[b] = s / s.sum()
            elif b:
                low[b] = low[b - 1]
            if b in s3 and b:
                high[b] = s3[b][1] / s3[b].sum()
            elif b > 1:
                high[b] = high[b - 1]
    low[0] = [0.0, low[0][0] + low[0][1], low[0][2]]
    held_score = held_base = 0.0
    for i, t in tokens.items():
        r = rows[i]
        base = sum(math.log10((full[0][w] + 0.5) / (n + 0.5 * (size + 1))) for w in t)
        score = sum(math.log10(parts(full, n, low, high, u, v, w)[2].sum()) for u, v, w in grams(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc[i] % 5 == 1, len(t), sum(full[0][w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-6)
        if r.held_out:
            held_score, held_base = held_score + score, held_base + base
    assert held_score > held_base - 1
    whole = sum(parts(full, n, low, high, "w1", "w2", w)[2].sum() for w in full[0])
    assert abs(whole + low[bucket(full[0]["w2"])][2] * (1 - high[bucket(full[3]["w1", "w2"])]) / (size + 1) - 1) < 1e-9


def test_counts_of_keys_are_rows_linear_in_the_units():
    fan, depth = keycounts.levels(10**15)
    assert fan <= keycounts.FAN and fan**depth >= 10**15 / keycounts.PART_KEYS
    assert keycounts.levels(100) == (1, 1)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    rows = keycounts.ask(7, False, keys, np.ones(len(keys), dtype=np.int64), fan).to_pylist()
    assert len(rows) <= fan and np.array_equal(np.concatenate([keycounts.unpack_keys(r["keys"]) for r in rows]), keys)


def test_lm_leaves_no_scratch(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    lm.score(spark.createDataFrame([("a b", 1, "", "", "")], SCHEMA)).collect()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before


def test_lm_empty_table(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_features_of_odd_texts():
    odd = ["", "\n", "a", "\n\nx\n", "é" * 50, "one  two", " \t"]
    for _, _, t in slices(pa.array(odd)):
        f, of, lengths = crf.line_features(t)
        assert np.isfinite(f).all() and len(of) == sum(x.count("\n") + 1 for x in odd) and (lengths >= 1).all()


def test_training_lines_are_bounded_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {k}" for k in range(10))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    all_ = crf.training_lines(docs, labels)
    monkeypatch.setattr(crf, "TRAIN_TOTAL", 55)
    few = crf.training_lines(docs, labels)
    assert len(all_) > 15 and len(few) == 5 and set(few["doc_id"]) < set(all_["doc_id"])
