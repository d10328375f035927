import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from deltascope.llm import simhash
from deltascope.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "text string, doc_id long, fp string, key string, part string, value string"


def brute_fp(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, k=3):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= k:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "ß x", "日本"]
    out = ["", None, " \n\t", "One", "one", "two words", "\x0b\x0cTWO\rWORDS", "long " * 4000]
    base = [r.choice(words) for _ in range(120)]
    for i in range(n):
        w = list(base) if i % 2 else [r.choice(words) for _ in range(r.randrange(1, 150))]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(r.choice([" ", "\n", "  "]).join(w))
    out += out[10:14]
    ids = list(range(0, 3 * len(out), 3))
    r.shuffle(ids)
    return list(zip(ids, out))


@pytest.mark.parametrize("block", [1024, 4])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.blocked, "__defaults__", (block,))
    rows = corpus(block, 60)
    docs = spark.createDataFrame([(t, d, "x", "x", "x", "x") for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "q r s t")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [4, 4, 4]


@pytest.mark.parametrize("k", [3, 6])
@pytest.mark.parametrize("n", [500, 10**6, 10**8])
def test_plan_keeps_the_pigeonhole_sum(k, n):
    fp = np.random.default_rng(3).integers(0, 1 << 63, 2000, dtype=np.uint64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    p = simhash.plan(n, bits.T @ bits * n / 2000, k)
    assert sum(t + 1 for _, t in p) == k + 1
    own = [b for bits, _ in p for b in bits]
    assert len(own) == len(set(own))


def test_planned_probes_find_all_pairs(spark):
    r = np.random.default_rng(5)
    fp = r.integers(0, 1 << 62, 300, dtype=np.uint64)
    near = fp.copy()
    for _ in range(3):
        near ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
    both = np.concatenate([fp, near]).view(np.int64)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in both], "key long, fp long")
    parts = [(list(range(0, 22)), 1), (list(range(22, 43)), 0), (list(range(43, 64)), 0)]
    edges = simhash.link(simhash.blocked(simhash.buckets(nodes, parts), "key"), 8, 3)
    found = {(min(e.a, e.b), max(e.a, e.b)) for e in edges.collect()}
    for x, y in zip(both[:300].tolist(), both[300:].tolist()):
        assert (min(x, y), max(x, y)) in found or x == y


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (100, 95), (7, 7), (90, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randrange(40, 200))]
        for edits in (0, 0, 1, 2, 4, 8, 20):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
    rows += ["", None, " \n", "Short text", "short  TEXT", "short text more"]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    import pyarrow as pa

    from deltascope.llm.textarrays import slices

    monkeypatch.setattr(simhash.blocked, "__defaults__", (block,))
    texts = near_corpus()
    lower = [WORD.findall((t or "").lower()) for t in texts]
    (_, _, t), = slices(pa.array([x or "" for x in texts]), lower=True)
    hashes = t.word_hashes()
    fps = [int(simhash.majority(np.unique(hashes[a:b]), np.array([0, len(np.unique(hashes[a:b]))]))[0]) for a, b in zip(t.words, t.words[1:])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in lower]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if lower[a] == lower[b] or (fps[a] ^ fps[b]).bit_count() <= 6 and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if root(i) == i}
    docs = spark.createDataFrame([(t, i, "c", "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    # links of similarity 0.8 that the fingerprints miss are few
    close = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and (c := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    assert sum(root(a) == root(b) for a, b in close) >= 0.9 * len(close)


def test_near_copies_of_odd_tables(spark):
    assert simhash.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "a b c d"), (5, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.drop_near_copies(docs).collect()) == ["4", "4", "5", "None"]


def test_cut_extended_and_inserted_copies_are_found(spark):
    r = random.Random(31)
    rows = []
    for i in range(60):
        w = [f"v{r.randrange(50_000)}" for _ in range(r.randrange(60, 400))]
        n, more = len(w), [f"v{r.randrange(50_000)}" for _ in range(400)]
        at = r.randrange(1, n)
        size = r.randrange(n // 8, n // 5 - 1)
        copy = (w[: n - size], w[size:], w + more[:size], more[:size] + w, w[:at] + more[:size] + w[at:], w[:at] + w[at + size :])[i % 6]
        rows += [" ".join(w), " ".join(copy)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, rows)]
    up = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            up[b] = min(up[a], up[b])
    want = {i for i in range(len(rows)) if up[i] == i}
    assert len(want) < len(rows) - 40
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "text string, doc_id long")
    assert {x.doc_id for x in simhash.drop_near_copies(docs).collect()} == want


@pytest.mark.parametrize("block", [1024, 3])
def test_a_band_of_many_groups_is_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.blocked, "__defaults__", (block,))
    r = random.Random(32)
    w = [f"v{i}" for i in range(300)]
    rows = [" ".join(w + [f"x{k}-{i}" for i in range(30)]) for k in range(12)] + [" ".join(f"y{i}" for i in range(50))]
    r.shuffle(rows)
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "text string, doc_id long")
    alone = next(i for i, t in enumerate(rows) if t.startswith("y"))
    first = min(i for i in range(len(rows)) if i != alone)
    assert {x.doc_id for x in simhash.drop_near_copies(docs).collect()} == {alone, first}


def test_texts_that_share_a_doc_id_are_judged_each_by_itself(spark):
    r = random.Random(33)
    w = [f"v{i}" for i in range(100)]
    long = " ".join(f"l{r.randrange(50_000)}" for _ in range(300))
    rows = [(1, " ".join(w)), (2, " ".join([*w[:50], "other", *w[51:]])), (2, long), (3, long + " end"), (4, "one text alone"), (4, " ".join(w)), (None, long)]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, key string")
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    want = [(None, long), (1, rows[0][1]), (2, long), (4, "one text alone")]
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted(want, key=str)
