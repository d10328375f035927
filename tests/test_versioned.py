import random
import threading

from pyspark.sql import functions as F

from deltascope.operators import review as rv
from deltascope.sources import store
from deltascope.sources.versioned import StoredImport

SCHEMA = "row_number long, x string, tags array<struct<a:int,b:string>>"


def rows(spark, numbers, x):
    return spark.createDataFrame([(n, x, [(n, x)]) for n in numbers], SCHEMA)


def found(df):
    return {r.row_number: r.x for r in df.collect()}


def test_upserts_pages_and_compaction(spark, tmp_path):
    r, path = random.Random(1), f"file://{tmp_path}/store"
    s = StoredImport(spark, path, "i")
    s.write(rows(spark, range(100, 1100, 2), "old"), files=5)
    want = {n: "old" for n in range(100, 1100, 2)}
    before = set(s.manifest.files("set=base-*/part-*.parquet"))
    for k in range(4):
        numbers = r.sample(range(50, 1200), 30)
        s.upsert(rows(spark, numbers, f"new {k}"))
        want |= {n: f"new {k}" for n in numbers}
        assert found(s.rows()) == want
        if k == 2:
            assert s.compact() and found(s.rows()) == want and not s.manifest.read()[1]["deltas"]
    order = sorted(want)
    for page, size in ((0, 100), (1, 7), (3, 100), (5, 100), (60, 9), (-1, 0), (9999, 10)):
        page_, size_ = max(0, page), max(1, min(size, 200))
        got = [(x.row_number, x.x, x.total_rows) for x in s.page(page, size).collect()]
        assert got == [(n, want[n], len(want)) for n in order[page_ * size_ : (page_ + 1) * size_]], (page, size)
    assert found(store.get_row(spark, path, "i", order[17])) == {order[17]: want[order[17]]}
    assert before & set(s.manifest.files("set=base-*/part-*.parquet"))
    gone = s.vacuum()
    assert gone and found(s.rows()) == want and not s.vacuum()
    assert s.rows().first().tags[0].a is not None


def test_a_page_opens_as_many_files_of_a_large_table_as_of_a_small_one(spark, tmp_path):
    opened = []
    for files in (4, 40):
        s = StoredImport(spark, f"file://{tmp_path}/p{files}", "i")
        s.write(spark.range(files * 500).select(F.col("id").alias("row_number"), F.lit("x").alias("x")), files)
        opened.append([len(s.page(p, 100).inputFiles()) for p in (0, 3, files * 2, files * 5 - 1)])
    print("files opened by page, of 4 and of 40 files:", opened)
    assert max(map(max, opened)) <= 2


def test_two_writers_at_once_and_one_that_dies(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    StoredImport(spark, path, "i").write(rows(spark, range(20), "old"), 2)
    wrong = []

    def write(k):
        try:
            for j in range(3):
                StoredImport(spark, path, "i").upsert(rows(spark, [k * 100 + j, 5], f"writer {k}"))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not wrong
    s = StoredImport(spark, path, "i")
    got = found(s.rows())
    assert {k * 100 + j for k in (1, 2, 3) for j in range(3)} <= set(got) and len(got) == 29 and got[5].startswith("writer")
    assert s.manifest.version() == 10 and s.page(0, 200).first().total_rows == 29
    made = s._put(rows(spark, [7, 8], "lost"), "delta")  # a writer that dies before its commit
    assert found(StoredImport(spark, path, "i").rows()) == got and s.vacuum() == [f["file"] for f in made]


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    s = StoredImport(spark, f"file://{tmp_path}/store", "i")
    s.write(rows(spark, range(30), "old"), 3)
    s.upsert(rows(spark, [3, 40], "first"))
    other, put = StoredImport(spark, f"file://{tmp_path}/store", "i"), s._put

    def slow(df, kind, files=None):
        out = put(df, kind, files)
        if kind == "base":
            s._put = put
            other.upsert(rows(spark, [3, 41], "second"))
        return out

    s._put = slow
    assert s.compact()
    got = found(s.rows())
    assert got[3] == "second" and got[40] == "first" and got[41] == "second" and len(got) == 32
    assert len(s.manifest.read()[1]["deltas"]) == 1 and s.page(0, 100).first().total_rows == 32
    s.write(rows(spark, [1], "all"))
    assert found(s.rows()) == {1: "all"}


def test_many_edits_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Their keys are small in a shuffle, but not as a table on the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    s = StoredImport(spark, f"file://{tmp_path}/store", "i")
    s.write(rows(spark, range(200), "old"), files=4)
    s.upsert(rows(spark, range(0, 200, 2), "new"), files=None)
    assert "Broadcast" not in plan(s.rows()) and found(s.rows()) == {n: "old" if n % 2 else "new" for n in range(200)}
    review = spark.range(300).selectExpr("id as row_number", "cast(id as double) as v", "false as excluded", f"cast(array() as array<{rv.CHANGE}>) as changes", f"cast(array() as array<{rv.ISSUE}>) as issues")
    edits = spark.range(0, 300, 3).selectExpr("id as row_number", "'edit' as action", "'v' as column", "'7' as value")
    for few, sent in ((1000, True), (50, False)):
        monkeypatch.setattr(rv, "FEW_EDITS", few)
        out = rv.apply_edits(review, edits, {"v": "number"})
        assert ("Broadcast" in plan(out)) == sent and {r.row_number: r.v for r in out.collect()} == {n: float(n) if n % 3 else 7.0 for n in range(300)}
