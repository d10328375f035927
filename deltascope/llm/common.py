"""Helpers shared by the operators: shared storage, lineage cuts, text slices."""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run without ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z only.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    spark.checkpoint.dir; where that is unset, a local one if all of Spark is on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages (and retries
    after a lost executor) start from those files."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_dir(table: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote, when nothing will read it again."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files when the query is done; every table
    that is read twice must have been written by `cut`."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared-folder URI, usable inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_range(fs: pafs.FileSystem, path: str, start: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, start)


def publish(base: str, name: str, data: bytes) -> str:
    """Write one file under a name no other attempt uses; a manifest row that
    Spark commits decides whether readers ever see it."""
    fs, root = store(base)
    fs.create_dir(root, recursive=True)
    path = f"{name}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(f"{root}/{path}") as f:
        f.write(data)
    return path


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def id_crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def texts(batch: pa.RecordBatch, column: str = "text", chars: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about so many bytes of text each; null text is empty.
    A batch may hold thousands of long documents, a slice bounds what Python holds."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes, dtype=np.int64) // chars
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, ["" if t is None else t for t in part[column].to_pylist()]


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """Start offsets (with the end) of consecutive runs."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 for every i, concatenated."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 30 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def release() -> None:
    """Give memory that a worker has freed back to the system: workers are used again by
    later tasks, and what they keep counts against the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
