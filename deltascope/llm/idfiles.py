"""Token-id files: canonical length-limited Huffman codes in independent blocks.

One code table for all files, from counts over the whole corpus. A file holds whole
documents in ascending doc_id order:

  8 bytes  magic "DSHUF001"
  4 x u32  length of the code table, documents, blocks, ids in a block
  u64      ids
  table    one byte for each id: its code length, 0 for unused ids
  i64 x documents  doc_id;  u8 x documents  1 where doc_id is null
  u64 x documents  ids of the document
  u64 x blocks     bit offset at which the block begins (the checkpoints)
  payload  code bits, most significant first

Codes are canonical: shorter first, then by id. A reader needs only the checkpoint of
a block to decode it, by one table look-up for each id.

A null text is empty; null doc_ids come first; rows that share a doc_id lie in the order of
their sizes, equal ones as they were read; a text of any length is encoded whole by one task. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_dir, new_dir, publish, read_range, shuffles_freed, spans_of, store, texts
from .tokens import encoder, id_kind

MAGIC, HEAD = b"DSHUF001", struct.Struct("<8s4IQ")
LIMIT, BLOCK = 16, 512
#: Ids in a file (a file ends after the document that reaches it) and in a partition.
FILE_IDS, PARTITION_IDS = 2_000_000, 8_000_000
MANIFEST = "pid int, seq int, path string, size long, ids_before long, n_ids long, n_docs long"


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (for more ids than these tell apart, two
    more than they need), by package-merge; a single id gets one bit."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    out = np.zeros(max(ids, default=-1) + 1, dtype=np.uint8)
    if len(ids) == 1:
        out[ids[0]] = 1
    if len(ids) < 2:
        return out
    if (len(ids) - 1).bit_length() > limit:  # large vocabularies need longer codes
        limit = (len(ids) - 1).bit_length() + 2
        if limit > 24:
            raise ValueError("more ids than a code of 24 bits can tell apart")
    leaves = np.array([counts[i] for i in ids], dtype=np.float64)
    # levels[k]: which entries of the k-th merged list are packages
    levels, merged = [], leaves
    packages = np.zeros(len(leaves), dtype=bool)
    for _ in range(limit - 1):
        levels.append(packages)
        paired = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, paired])
        order = np.argsort(both, kind="stable")
        merged, packages = both[order], order >= len(leaves)
    levels.append(packages)
    take = 2 * len(ids) - 2
    lengths = np.zeros(len(ids), dtype=np.int64)
    for packages in reversed(levels):
        chosen = packages[:take]
        n_packages = int(chosen.sum())
        lengths[: take - n_packages] += 1  # the leaves of a list come in ascending order
        take = 2 * n_packages
    out[ids] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= 1
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and where each block begins."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint64)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    code = codes[ids].astype(np.uint64)
    word, over = at >> 6, (at & 63) + n - 64
    left = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word: each word has one that begins in it
    words = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    words[: len(firsts)] = np.bitwise_or.reduceat(left, firsts)
    cross = np.flatnonzero(over > 0)
    words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], at[::block].astype(np.uint64)


def decode_bits(payload: bytes, checkpoints: np.ndarray, n_ids: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """All ids; step k decodes the k-th id of every block at once, from its checkpoint."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    limit, kind = max(LIMIT, int(lengths.max(initial=0))), id_kind(len(lengths))
    symbol, bits = np.zeros(1 << limit, dtype=kind), np.zeros(1 << limit, dtype=np.uint8)
    order = used[np.lexsort((used, lengths[used]))]
    shift = limit - lengths[order].astype(np.int64)
    runs = np.int64(1) << shift
    begin = codes[order].astype(np.int64) << shift
    total = int(runs.sum())
    symbol[:total], bits[:total] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    assert not len(begin) or begin[0] == 0
    raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((block, len(checkpoints)), dtype=kind)
    at = checkpoints.astype(np.int64)
    live = len(checkpoints)
    tail = n_ids - (live - 1) * block if live else 0
    for k in range(block):
        if k == tail:
            live -= 1
            at = at[:live]
        if not live:
            break
        looked = (window[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[k, :live] = symbol[looked]
        at = at + bits[looked]
    return out.T.ravel()[:n_ids] if len(checkpoints) else np.zeros(0, dtype=kind)


def file_bytes(doc_ids: list, counts: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    payload, checkpoints = encode_bits(ids, lengths, codes)
    head = HEAD.pack(MAGIC, len(lengths), len(doc_ids), len(checkpoints), BLOCK, len(ids))
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join(
        [head, lengths.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(counts, "<u8").tobytes(), checkpoints.astype("<u8").tobytes(), payload]
    )


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each, all ids, from the bytes of a file."""
    magic, n_table, n_docs, n_blocks, block, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size
    parts = []
    for kind, n in (("u1", n_table), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_blocks)):
        parts.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    lengths, doc_ids, null, counts, checkpoints = parts
    ids = decode_bits(data[at:], checkpoints, n_ids, lengths, block)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())], counts.astype(np.int64), ids


def token_table(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian, 16 bits each or 32 if the
    vocabulary needs them) and row, a number of its own for each row."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part, _ in texts(batch, chars=8 << 20):
                ids, counts = enc.encode(part["text"], end)
                edges = spans_of(counts).tolist()
                raw, k = ids.tobytes(), ids.itemsize
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array([raw[k * a : k * b] for a, b in zip(edges, edges[1:])], pa.binary())], names=["doc_id", "n", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def id_counts(tokens: DataFrame, size: int) -> dict[int, int]:
    """Count of each id over the corpus: at most one number for each id of the vocabulary
    (`size`) reaches the driver."""
    kind = id_kind(size)

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def write(tokens: DataFrame, base: str, size: int) -> DataFrame:
    """Write the token table to files under `base`; returns the manifest, one row for
    each file. Files that no manifest names (of lost attempts) are never read."""
    counts, kind = id_counts(tokens, size), id_kind(size)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    parts = max(1, math.ceil(sum(counts.values()) / PARTITION_IDS))

    def run(batches):
        from pyspark import TaskContext

        pid, seq, before = TaskContext.get().partitionId(), 0, 0
        docs, sizes, chunks, held = [], [], [], 0

        def flush():
            data = file_bytes(docs, sizes, np.concatenate(chunks), lengths, codes)
            path = publish(base, f"ids-{pid:06d}-{seq:04d}", data)
            return pa.RecordBatch.from_pylist([{"pid": pid, "seq": seq, "path": path, "size": len(data), "ids_before": before, "n_ids": held, "n_docs": len(docs)}], schema=arrow)

        arrow = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("size", "ids_before", "n_ids", "n_docs"))])
        for batch in batches:
            for doc, n, ids in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["ids"]):
                docs.append(doc)
                sizes.append(n)
                chunks.append(np.frombuffer(ids.as_py(), dtype=kind))
                held += n
                if held >= FILE_IDS:
                    yield flush()
                    seq, before = seq + 1, before + held
                    docs, sizes, chunks, held = [], [], [], 0
        if docs:
            yield flush()

    # rows that share a doc_id (or have none) can go to several tasks, by their own numbers
    ordered = tokens.repartitionByRange(parts, "doc_id", "n", "row").sortWithinPartitions("doc_id", "n", "row")
    return cut(ordered.mapInArrow(run, MANIFEST), "ids-manifest")


def read(spark: SparkSession, manifest: DataFrame, base: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    # ids before each writing task: sums of 1024 tasks each, and within these
    tasks = manifest.groupBy("pid").agg(F.sum("n_ids").alias("n")).withColumn("some", F.shiftright("pid", 10))
    some = tasks.groupBy("some").agg(F.sum("n").alias("n"))
    over = Window.orderBy("some").rowsBetween(Window.unboundedPreceding, -1)  # one row for 1024 tasks
    some = some.select("some", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("some").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("some", "pid", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("own")).join(some, "some")
    manifest = cut(manifest.join(starts.select("pid", (F.col("base") + F.col("own")).alias("base")), "pid"), "ids-places")

    def run(batches):
        fs, root = store(base)
        for batch in batches:
            for f in batch.to_pylist():
                docs, counts, ids = read_file(read_range(fs, f"{root}/{f['path']}", 0, f["size"]))
                edges = spans_of(counts)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
                start = edges[:-1] + f["base"] + f["ids_before"]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "pid", "seq").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, read back. Null texts are empty (their end id only); an empty
    table gives no files and no rows; rows that share a doc_id lie side by side."""
    spark = docs.sparkSession
    tokens = cut(token_table(docs, tokenizer), "ids-tokens")
    base = new_dir(spark, "ids-files")
    with shuffles_freed(spark):
        manifest = write(tokens, base, encoder(tokenizer).tokenizer.get_vocab_size())
    drop_dir(tokens)
    return read(spark, manifest, base)
