import random
import re
from collections import Counter

import numpy as np
import pytest

from deltascope.llm import decontaminate as dec

DOCS = "text string, doc_id long, item_id string, score string, shard string"
ITEMS = "text string, item_id long, doc_id string, shard string"


def corpus():
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [sentence(r.randrange(8, 25)).capitalize() + ". " + sentence(r.randrange(1, 12)) + "." for _ in range(30)] + ["Single sentence item with several words in one run here", "Tiny.", "", None]
    docs, leaks = [], set()
    for i in range(80):
        text = sentence(r.randrange(0, 200))
        if i % 4 == 0:
            k = r.randrange(31)
            item = items[k]
            if i % 8 == 0:
                item = item.upper().replace(" ", "\n ")
            text = text + " " + item + " " + sentence(r.randrange(100))
            leaks.add((i, k))
        docs.append(text)
    half = " ".join(items[3].split()[: len(items[3].split()) // 2])
    docs += ["", None, half + " " + sentence(50), "x " * 20000 + items[5], items[6] + " " + items[7]]
    leaks |= {(83, 5), (84, 6), (84, 7)}
    return docs, items, leaks


def brute_scores(words, items):
    docs = [dec.words_of(t or "") for t in items]
    n, mean = sum(len(d) > 0 for d in docs), np.mean([len(d) for d in docs if len(d)])
    df = Counter(h for d in docs for h in set(d.tolist()))
    out = {}
    for i, d in enumerate(docs):
        if not len(d):
            continue
        tf = Counter(d.tolist())
        s = {h: np.log(1 + (n - df[h] + 0.5) / (df[h] + 0.5)) * c * (dec.K1 + 1) / (c + dec.K1 * (1 - dec.B + dec.B * len(d) / mean)) for h, c in tf.items()}
        out[i] = sum(v for h, v in s.items() if h in words) / sum(s.values())
    return out


@pytest.mark.parametrize("block", [2, 8])
def test_wand_finds_all_above_threshold(monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK", block)
    docs, items, _ = corpus()
    lists = [dec.words_of(t or "") for t in items]
    df = Counter(h for d in lists for h in set(d.tolist()))
    index = dec.Index(list(range(len(items))), items, df, sum(len(d) > 0 for d in lists), float(np.mean([len(d) for d in lists if len(d)])))
    for t in docs[:40]:
        words = dec.words_of(t or "")
        _, codes = index.codes(words)
        terms = np.unique(codes)
        for threshold in (0.2, 0.5):
            got = {index.ids[i]: s for i, s in index.search(terms, list(range(index.n_blocks)), threshold)}
            want = {i: s for i, s in brute_scores(set(words.tolist()), items).items() if s >= threshold}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_leaks_equal_planted_ones_and_brute_force(spark):
    docs, items, leaks = corpus()
    d = spark.createDataFrame([(t, i, "c", "c", "c") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(t, i, "c", "c") for i, t in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in dec.find_leaks(d, b).collect()}
    assert leaks <= got.keys()
    norm = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    for (i, k), r in got.items():  # no leak without the item's words in the text
        w = norm(items[k])
        assert len(set(w) & set(norm(docs[i]))) >= 0.8 * len(set(w)) and min(r.question_overlap, r.answer_overlap) >= 0.8 and r.score >= 0.6
    kept = {r.doc_id for r in dec.drop_leaks(d, b).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in got}


def brute_leaks(docs, items):
    """All passages of all texts against all items, by shard (items of one power of two)."""
    shards = {}
    for k, t in enumerate(items):
        n = len(dec.words_of(t or ""))
        if n:
            shards.setdefault(max(dec.LEAST_SCALE, n.bit_length()), []).append((k, n))
    out = set()
    for i, text in enumerate(docs):
        words = dec.words_of(text or "")
        for own in shards.values():
            segment = max(32, max(n for _, n in own))
            for a in range(0, len(words), segment):
                b = min(a + 2 * segment, len(words))
                scores = brute_scores(set(words[a:b].tolist()), items)
                near = words[max(0, a - segment) : min(len(words), b + segment)]
                for k, _ in own:
                    if scores[k] >= dec.THRESHOLD - 1e-9:
                        w = dec.words_of(items[k])
                        cut = dec.answer_from(items[k], w)
                        size = min(5, len(w))
                        grams = {tuple(near[j : j + size].tolist()) for j in range(len(near) - size + 1)}
                        covered = np.zeros(len(w), dtype=bool)
                        for j in range(len(w) - size + 1):
                            if tuple(w[j : j + size].tolist()) in grams:
                                covered[j : j + size] = True
                        if len(w) < 5:
                            covered[:] = covered.all()
                        if (not cut or covered[:cut].mean() >= dec.OVERLAP) and covered[cut:].mean() >= dec.OVERLAP:
                            out.add((i, k))
    return out


@pytest.mark.parametrize("scale", [3, 7])
def test_leaks_equal_brute_force_over_all_passages(spark, monkeypatch, scale):
    monkeypatch.setattr(dec, "LEAST_SCALE", scale)
    docs, items, _ = corpus()
    docs = docs[:60] + docs[-5:-2] + docs[-1:]
    near = [" ".join(w for j, w in enumerate(items[k].split()) if j % m) for k in range(12) for m in (3, 9, 15)]
    docs += near
    d = spark.createDataFrame([(t, i, "c", "c", "c") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(t, i, "c", "c") for i, t in enumerate(items)], ITEMS)
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()} == want and len(want) > 15


def test_shards_and_passes_find_the_same(spark, monkeypatch):
    docs, items, _ = corpus()
    d = spark.createDataFrame([(t, i, "c", "c", "c") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(t, i, "c", "c") for i, t in enumerate(items)], ITEMS)
    one = sorted((r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect())
    monkeypatch.setattr(dec, "SHARD_WORDS", 120)
    monkeypatch.setattr(dec, "PASS_BYTES", 200_000)
    assert 2 <= len(list(dec.passes(b))) < dec.shard_indexes(b).count()
    assert sorted((r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()) == one


def test_many_items_take_one_pass(spark, capsys):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [sentence(r.randrange(20, 40)) + ". " + sentence(6) for _ in range(20_000)]
    docs = [sentence(400) + " " + items[997 * i] + " " + sentence(100) for i in range(20)] + [sentence(600) for _ in range(20)]
    b = spark.createDataFrame([(t, i) for i, t in enumerate(items)], "text string, item_id long")
    (indexes,) = dec.passes(b)
    size, postings = len(dec.pickle.dumps(indexes)), sum(len(x.items) for x in indexes)
    with capsys.disabled():
        print(f"\n20,000 items: {len(indexes)} shards, {size / 1e6:.1f} MB, {postings} postings")
    assert size < 60 * postings
    d = spark.createDataFrame([(t, i) for i, t in enumerate(docs)], "text string, doc_id long")
    assert {(x.doc_id, x.item_id) for x in dec.find_leaks(d, b).collect()} == {(i, 997 * i) for i in range(20)}


def test_ids_of_other_types_and_columns(spark):
    b = spark.createDataFrame([("How many legs has a spider that lives in a barn? Eight legs it has indeed", "mmlu-1"), (None, None), (None, "mmlu-1")], "text string, item_id string")
    d = spark.createDataFrame([("so: how many legs has a spider that lives in a barn? eight legs it has indeed", None, "x"), (None, 1, "x"), ("", 1, None)] * 2, "text string, doc_id long, _n string")
    assert [(r.doc_id, r.item_id) for r in dec.find_leaks(d, b).collect()] == [(None, "mmlu-1")] * 2
    assert sorted(map(str, dec.drop_leaks(d, b).collect())) == sorted(map(str, d.where("doc_id is not null").collect()))


def test_empty_tables(spark):
    docs, items, _ = corpus()
    d = spark.createDataFrame([(t, i, "c", "c", "c") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(t, i, "c", "c") for i, t in enumerate(items)], ITEMS)
    assert dec.find_leaks(d, b.limit(0)).count() == 0 and dec.find_leaks(d.limit(0), b).count() == 0
    assert dec.drop_leaks(d, b.limit(0)).count() == len(docs)
