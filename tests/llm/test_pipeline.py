import os
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_stages_keep_rows_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    from deltascope.llm import crf, decontaminate, secretscan, simhash
    from deltascope.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen, frames = docs, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, DIR).write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(seen)
    for f in frames[:-1]:
        assert f.columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert ids[1] == {r.doc_id for r in crf.classify(docs, labels).where("predicted = 1").collect()}
    assert ids[2] < ids[1] and ids[2] == {r.doc_id for r in simhash.drop_near_copies(frames[1]).collect()}
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.find_leaks(frames[2], items).collect()}
    assert ids[4] == ids[3] == ids[5]
    before = {r.doc_id: r.text for r in frames[3].collect()}
    a = secretscan.automaton()
    for r in frames[4].collect():
        (spans,) = secretscan.scan([before[r.doc_id]], a)
        assert r.text == secretscan.masked(before[r.doc_id], spans) and r.n_chars == len(r.text)
    t = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in frames[4].collect()}
    rows = seen.collect()
    for r in rows:
        whole = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and equal texts, repeated ids, columns with inner names, no rows."""
    good = "The river walks slowly under the old stone bridge and turns towards the sea where nets hang in the wind."
    rows = [(None, None, "en", "s", None), ("", 1, "en", "s", 0), (good, 2, None, None, len(good)), (good, 2, None, None, len(good)), (good, 3, "en", "s", len(good)), (good + " secret=abcdefghijklmnop", 4, "en", "s", 0), (good, None, "x", "y", 1)]
    schema = "text string, doc_id long, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "g", "i", "k") for r in rows], schema + ", _gone string, _id string, _key string")
    for table in (docs, docs.limit(0)):
        seen = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = spark.createDataFrame(stage(spark, seen, DIR).collect(), seen.schema)
            assert seen.columns == table.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, seen, DIR).collect()
        assert len(packed) == seen.count()
    dedup = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, DIR).collect()
    assert sorted(str(r.doc_id) for r in dedup) == ["1", "2", "2", "None", "None"]  # 4 is a near copy of 2
