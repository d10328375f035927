import hashlib
import random

import pytest

from deltascope.llm import linededup

SCHEMA = "h1 long, text string, of string, doc_id long, n_chars int, row string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=5, min_chars=40):
    """The lines that each row keeps, and the number before."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    where = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(doc)
    least = lambda d: -(1 << 63) if d is None else d
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(where[key(x)]) >= min_docs and least(doc) != max(map(least, where[key(x)])))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made_up(seed):
    r = random.Random(seed)
    common = [f"{c * 20} footer of every page, number {c}" + "é" * 10 for c in "abcdefgh"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(0, 12)):
            x = r.choice(common) if r.random() < 0.5 else r.choice(["", "short", f"own line {i} " + "x" * 40, "y" * 39, "z" * 40])
            x = x.upper() if r.random() < 0.2 else x
            lines.append(r.choice(["", " ", "\t\r"]) + x + r.choice(["", " \x0b", "\r"]))
        rows.append((i * 3, None if i == 7 else "\n".join(lines)))
    rows += [rows[3], rows[3], (None, "\n".join(common)), (6, "\n".join(common[:3]) + "\n"), (180, "\n" * 5)]
    return rows


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 6)])
def test_lines_equal_brute_force(spark, seed, batches):
    rows = made_up(seed)
    docs = spark.createDataFrame([(1, t, "x", d, 5, "y") for d, t in rows], SCHEMA).repartition(5)
    want = brute(rows)
    got = linededup.digests(docs, batches=batches, buckets=3).collect()
    as_rows = lambda d, n, k, t: (str(d), n, k, hashlib.sha256(t.encode()).hexdigest())
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(as_rows(*w) for w in want)
    assert sum(w[2] for w in want) > 20
    if seed == 1:
        new = linededup.drop_repeated(docs, batches=batches, buckets=3)
        assert new.columns == docs.columns
        texts = {(str(d), t) for d, _, _, t in want}
        assert all((str(r.doc_id), r.text or "") in texts and r.row == "y" and r.n_chars in (5, len(r.text or "")) for r in new.collect())


def test_later_batches_find_earlier_lines_as_known(spark):
    runs = linededup.open_runs(spark, linededup.new_dir(spark, "test-runs"), 3)
    for i in range(6):
        batch = linededup.cut(spark.createDataFrame([(k, k, 1, 100 - i) for k in range(i, i + 10)], linededup.RUN), "test-batch")
        linededup.add_batch(runs, batch, str(i))
    assert [r["level"] for r in runs.runs()].count(1) == 1 and len(runs.runs()) == 3  # four runs became one
    got = {r.h1: (r.documents, r.keeper) for r in runs.totals().collect()}
    assert got == {k: (len([i for i in range(6) if i <= k < i + 10]), 100 - max(0, k - 9)) for k in range(15)}
    runs.drop()


def test_hot_line_long_text_and_empty_table(spark):
    line = "this very line stands in all documents, whatever they are"
    rows = [(i, line + f"\nand {i} is the number of this one and of no other document") for i in range(300)] + [(1000, "\n".join([line, "w" * 100] * 50_000))]
    got = {r.doc_id: r for r in linededup.digests(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()}
    assert got[1000].n_dropped == 0 and got[1000].n_lines == 100_000
    assert all(got[i].n_dropped == 1 for i in range(300))
    assert linededup.digests(spark.createDataFrame([], "doc_id long, text string"), buckets=4).count() == 0
