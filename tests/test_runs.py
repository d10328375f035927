import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deltascope.sources.manifest import Conflict, Manifest
from deltascope.sources.runs import LevelledRuns, push_literals
from deltascope.streaming import ingest


def test_manifest_versions_and_conflicts(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.read() == (0, {})
    m.commit(1, {"a": [1, "é"]})
    other = Manifest(spark, f"file://{tmp_path}/m")
    assert other.read() == (1, {"a": [1, "é"]})
    m.commit(2, {"a": 2})
    with pytest.raises(Conflict):
        other.commit(2, {"a": 3})
    assert other.read() == (2, {"a": 2}) and not [p for p in (tmp_path / "m").iterdir() if p.name.startswith("_staged")]
    m.commit(3, {})
    m.drop_versions(1)
    assert [p.name for p in (tmp_path / "m").glob("_manifest-*.json")] == ["_manifest-0000000003.json"]


def bytes_read(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(True)
    return sum(found.apply(i).totalInputBytes() for i in range(found.size()))


def test_absent_marked_replay_and_another_session(spark, tmp_path):
    r = random.Random(4)
    path, seen = f"file://{tmp_path}/runs", set()
    for b in range(6):
        store = LevelledRuns(spark if b % 2 else spark.newSession(), path, "k1 long, k2 long, n long", ["k1", "k2"], {"n": F.sum}, buckets=3, fanout=3)
        keys = {(r.randrange(40), r.randrange(3)) for _ in range(25)}
        rows = store.spark.createDataFrame([(*k, 1) for k in keys], "k1 long, k2 long, n long")
        for _ in range(2 if b in (1, 4) else 1):  # the batch comes twice
            assert {tuple(x)[:2] for x in store.absent(rows, str(b)).collect()} == keys - seen
            assert {(x.k1, x.k2) for x in store.marked(rows, str(b)).collect() if x.known} == keys & seen
            store.add(rows, str(b))
        seen |= keys
    total = {(x.k1, x.k2): x.n for x in store.totals().collect()}
    assert set(total) == seen and sum(total.values()) > len(seen)
    levels = [x["level"] for x in store.runs()]
    assert len(levels) <= 4 and max(levels) == 1 and all(levels.count(x) <= 3 for x in levels)
    store.compact(everything=True)
    assert len(store.runs()) == 1 and {(x.k1, x.k2): x.n for x in store.totals().collect()} == total
    with pytest.raises(ValueError, match="merged already"):
        store.add(rows, "2")
    folders = [p for p in (tmp_path / "runs").iterdir() if p.is_dir()]
    assert len(folders) == 1  # what was merged is gone
    store.drop()
    assert not (tmp_path / "runs").exists()


def test_lookups_read_as_much_for_the_tenth_batch_as_for_the_first(spark, tmp_path):
    """Batches of 2,500 rows: the rows of a day come within two batches. Bytes that a batch's
    lookup reads stay flat, while the stored signatures grow tenfold."""
    own = spark.newSession()
    push_literals(own)
    path = f"file://{tmp_path}/signatures"
    store = ingest.signature_store(own, path, buckets=2)
    day = dt.date(2024, 1, 1)
    read = []
    for b in range(11):
        rows = [(f"row {i}", day + dt.timedelta(days=i // 200)) for i in range(b * 2000, b * 2000 + 2500)]
        df = own.createDataFrame(rows, "x string, day date").withColumn("row_signature", F.sha2(F.concat("x", F.col("day").cast("string")), 256))
        df = ingest.signature_keys(df, "day").select("near", "k1", "k2")
        df.write.parquet(f"{tmp_path}/batch-{b}")
        df = own.read.parquet(f"{tmp_path}/batch-{b}")
        store.compact(but=str(b))
        fresh = store.absent(df, str(b))
        before = bytes_read(own)
        fresh.write.parquet(f"{tmp_path}/fresh-{b}")
        read.append(bytes_read(own) - before)
        fresh = own.read.parquet(f"{tmp_path}/fresh-{b}")
        assert fresh.count() == (2500 if b == 0 else 2000)  # 500 rows of the batch before come again
        store.add(fresh, str(b))
    print("bytes of lookups by batch:", read, "runs:", [r["level"] for r in store.runs()])
    assert max(read[2:]) < 2 * min(read[2:])
    assert read[-1] < 1.6 * read[2]


def test_running_totals_survive_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "totals", "check"))
    schema = "m decimal(12,2), day date, x string"
    want = {}
    for step in range(2):  # the second query starts where the first has stopped
        for k in range(2):
            rows = [(i + k, dt.date(2024, 1 + i % 3, 1), f"v{i % 4}") for i in range(step * 7, 20 + k)]
            for m, d, x in rows:
                for key in ((f"2024-0{d.month}", "x", x), (f"2024-0{d.month}", "__total__", "__all__")):
                    total, n = want.get(key, (0, 0))
                    want[key] = total + m, n + 1
            spark.createDataFrame(rows, "m long, day date, x string").withColumn("m", F.col("m").cast("decimal(12,2)")).coalesce(1).write.mode("append").parquet(source)
        own = spark.newSession()
        own.conf.set("spark.sql.shuffle.partitions", "2")
        stream = ingest.file_stream(own, source, own.read.parquet(source).schema)
        ingest.keep_totals(stream, out, check, "m", "day", ["x"]).awaitTermination(120)
        got = {(r.period, r.dimension, r.segment): (r.metric_total, r.record_count) for r in ingest.latest_totals(spark, out).collect()}
        assert got == want
    assert schema and spark.read.parquet(out).select("batch").distinct().count() == 4
