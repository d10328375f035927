import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from deltascope.llm import idfiles, packing  # noqa: E402
from deltascope.llm.tokens import encoder  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "x", "a\x1cb\r\x85 é é ́x  <|endoftext|> q<|startoftext|>'s 's z", "\n\n \t", "ABC<|ENDOFTEXT|> it's dont'S. 'll... w're.x É.É ß. İx. ΣΑΣ σ. 12.3 a1.b x.,y;z", "日本語 テキスト。 word", "a" * 5000, "a.b!c " * 3000]
SCHEMA = "text string, doc_id long, ids string, length string, n string, _item int"


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [list(e.ids) + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_plain_encoding():
    ids, counts = encoder(PATH).encode(pa.array(ODD * 2), 1)
    got, at = [], 0
    for n in counts:
        got.append(ids[at : at + n].tolist())
        at += n
    assert got == plain(ODD * 2)


def test_best_fit_keeps_bins_within_capacity():
    lengths = np.random.default_rng(1).integers(1, 101, 5000)
    bins, places, fills = packing.best_fit(lengths, 100)
    assert fills.max() <= 100 and fills.sum() == lengths.sum()
    assert len(fills) <= 1.01 * lengths.sum() / 100 + 1
    assert (places + lengths <= fills[bins]).all()


@pytest.mark.parametrize("items", [8192, 16])
def test_pack_whole_and_gapless(spark, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)  # many partitions and rounds even for a small table
    texts = ODD + ["ab cd " * k for k in range(1, 120)] + ["same text"] * 30
    docs = spark.createDataFrame([(t, i, "clash", "clash", "clash", 7) for i, t in enumerate(texts)], SCHEMA)
    out = packing.pack(packing.pieces(docs, PATH, capacity=512), capacity=512).toPandas()
    want = {(i, k): (512 * k, len(p := ids[512 * k : 512 * k + 512]), crc(p)) for i, ids in enumerate(plain(texts)) for k in range(-(-len(ids) // 512))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    assert len(out) == len(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 512
    assert out.sequence_id.nunique() <= 1.05 * out.length.sum() / 512 + 2


def test_pack_more_than_half_full_items_end(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 8)
    rows = spark.createDataFrame([(i, 60) for i in range(200)], "x int, length int")
    assert packing.pack(rows, capacity=100).select("sequence_id").distinct().count() == 200


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0
    assert idfiles.round_trip(docs, PATH).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = {i: int(c) for i, c in enumerate(rng.zipf(1.3, 300))}
    import heapq

    heap = [(c, i, (i,)) for i, c in counts.items()]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    free = idfiles.code_lengths(counts, 40)
    assert sum(int(free[i]) * c for i, c in counts.items()) == cost
    tight = idfiles.code_lengths(counts, 9)
    assert tight.max() <= 9 and sum(2.0 ** -int(n) for n in tight) == 1.0
    fib = {i: c for i, c in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])}
    assert idfiles.code_lengths(fib, 4).max() == 4


@pytest.mark.parametrize("n", [1, 511, 512, 513, 40_000])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_bits_round_trip(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.2, n) % kinds).astype(np.uint16)
    values, counts = np.unique(ids, return_counts=True)
    lengths = idfiles.code_lengths(dict(zip(values.tolist(), counts.tolist())))
    payload, marks = idfiles.encode_bits(ids, lengths, idfiles.canonical(lengths))
    assert (idfiles.decode_bits(payload, marks, n, lengths) == ids).all()
    # one block alone, from its checkpoint
    k = len(marks) - 1
    assert (idfiles.decode_bits(payload, marks[k:], n - k * idfiles.BLOCK, lengths) == ids[k * idfiles.BLOCK :]).all()


def test_id_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_IDS", 300)
    monkeypatch.setattr(idfiles, "PARTITION_IDS", 4000)
    texts = ODD + ["some words here"] * 40
    docs = spark.createDataFrame([(t, 5 * ((i * 37) % len(texts)), "c", "c", "c", 1) for i, t in enumerate(texts)], SCHEMA)
    out = idfiles.round_trip(docs, PATH).orderBy("doc_id").collect()
    rows = sorted((5 * ((i * 37) % len(texts)), ids) for i, ids in enumerate(plain(texts)))
    at = 0
    for r, (doc, ids) in zip(out, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_id_files_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string")
    out = idfiles.round_trip(docs, PATH).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) for r in out) == [(-1, 0, 3), (3, 3, 1), (3, 4, 2), (3, 6, 2)]


def test_ids_of_32_bits():
    r = np.random.default_rng(3)
    used = np.unique(r.integers(0, 200_000, 90_000))
    counts = dict(zip(used.tolist(), r.integers(1, 50, len(used)).tolist()))
    lengths = idfiles.code_lengths(counts)
    assert lengths.max() <= 19 and (2.0 ** -lengths[used].astype(float)).sum() <= 1
    ids = r.choice(used, 5000)
    payload, marks = idfiles.encode_bits(ids, lengths, idfiles.canonical(lengths))
    back = idfiles.decode_bits(payload, marks, len(ids), lengths)
    assert back.dtype == np.dtype("<u4") and (back == ids).all()
    data = idfiles.file_bytes([7], [len(ids)], ids.astype("<u4"), lengths, idfiles.canonical(lengths))
    assert (idfiles.read_file(data)[2] == ids).all()


def test_packing_with_clashing_names_and_equal_rows(spark):
    schema = "doc_id long, length long, _item string, _fill string, _at string, _closed string, _deal string"
    rows = [(None, 1000, "a", "b", None, "d", "e")] * 50 + [(i, 96, None, None, "c", None, None) for i in range(12)]
    got = packing.pack(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 62 and len({r.sequence_id for r in got}) == 13
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(map(str, rows))
