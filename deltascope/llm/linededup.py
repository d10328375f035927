"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

Documents come in batches of falling doc_id. Each batch's lines, as (hash, documents), are
merge-anti-joined with the runs of the batches before it: a line that no run holds is new, and the
batch's largest doc_id with it keeps it; of a known line only the number of documents is
added. The batch then becomes a run itself; full levels are merged (`sources.runs`). In the end
each line's key has its documents and its keeper in the runs, and the lines of keys with
enough documents go, except the keeper's.

A key is a line without ASCII white space at its ends and with A-Z lower-cased; keys are told
apart by two independent 64-bit hashes. Documents are told apart by doc_id: rows that share
one are one document, so repeated rows do not make a line repeated, and keep or lose
their lines alike. A null text is empty, an empty text is one empty line; a null doc_id is a
document and less than any other. Very long texts are split where they lie. Lines are made
one for a document and then counted, both map-side first, and the join of all lines with the
repeated keys is one that Spark can split, so a line that most documents hold is no hot
group. An empty table gives no rows; further columns may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import LevelledRuns
from .common import LOWER, UPPER, cut, drop_dir, new_dir, stored_bytes, texts

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that one table is taken in.
BATCHES = 4
#: Bytes of written line hashes that one bucket of the runs is made for, and the fewest and
#: most buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, (4, 8192)
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
RUN = "h1 bigint, h2 bigint, documents bigint, keeper bigint"
#: Stands for a null doc_id, which no other id is less than.
LEAST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (nulls replaced), a hash that tells the texts of one doc_id apart, the text and
    the row itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("of"), text.alias("body"), F.struct("*").alias("row"))


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, of, at, h1, h2 for each line whose key has enough characters."""
    key = F.translate(F.btrim(F.col("line"), F.lit(SPACE)), UPPER, LOWER)
    split = _keyed(docs).select("doc", "of", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    kept = split.select("doc", "of", "at", key.alias("key")).where(F.char_length("key") >= min_chars)
    return kept.select("doc", "of", "at", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def open_runs(spark: SparkSession, path: str, buckets: int = BUCKETS[0]) -> LevelledRuns:
    return LevelledRuns(spark, path, RUN, ["h1", "h2"], {"documents": F.sum, "keeper": F.max}, buckets=buckets)


def held(found: DataFrame) -> DataFrame:
    """For each key of some lines, how many documents hold it and the largest of them."""
    return found.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc").alias("keeper"))


def add_batch(runs: LevelledRuns, batch: DataFrame, name: str) -> None:
    """Anti-join a batch (h1, h2, documents, keeper) with the runs and add it to them. Only
    new keys bring a keeper: that of a known one was stored by an earlier batch."""
    keeper = F.when(~F.col("known"), F.col("keeper")).alias("keeper")
    runs.add(runs.marked(batch, name).select("h1", "h2", "documents", keeper), name)


def repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """doc, of, dropped: the places of the lines that each text loses, where it loses any."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    cuts = docs.agg(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = F.lit(0)  # 0 has the largest ids
    for c in sorted(set(cuts)):
        number = number + (F.col("doc") <= c).cast("int")
    path, schema = new_dir(spark, "lines"), "doc long, of long, at int, h1 long, h2 long, batch int"
    lines(docs, min_chars).withColumn("batch", number).write.partitionBy("batch").parquet(path, compression="zstd")
    found = spark.read.schema(schema).parquet(path)
    found.scratch = path
    buckets = buckets or max(BUCKETS[0], min(BUCKETS[1], stored_bytes(spark, path) // BUCKET_BYTES))
    runs = open_runs(spark, new_dir(spark, "line-runs"), buckets)
    for i in range(len(set(cuts)) + 1):
        add_batch(runs, held(found.where(F.col("batch") == i)), str(i))
    # written, so that the lines' side of the join hangs on no aggregation and can be split
    often = cut(runs.totals().where(F.col("documents") >= min_docs), "lines-often")
    gone = found.join(often.hint("merge"), ["h1", "h2"]).where("doc <> keeper").groupBy("doc", "of").agg(F.collect_set("at").alias("dropped"))
    out = cut(gone, "lines-dropped")  # a row for each document that loses lines
    drop_dir(found)
    drop_dir(often)
    runs.drop()
    return out


def _kept(text: str, dropped: list[int] | None) -> tuple[str, int, int]:
    """The text without the dropped lines, its lines before, and how many it lost."""
    if not dropped:
        return text, text.count("\n") + 1, 0
    all_lines, gone = text.split("\n"), set(dropped)
    return "\n".join(x for i, x in enumerate(all_lines) if i not in gone), len(all_lines), len(gone)


def _joined(docs: DataFrame, **how) -> DataFrame:
    """Always dealt out by document: broadcasting the places while they are few would only
    hide what the join costs once they are many."""
    return _keyed(docs).join(repeated(docs, **how).hint("merge"), ["doc", "of"], "left")


def drop_repeated(docs: DataFrame, **how) -> DataFrame:
    """The documents without their repeated lines; all rows and columns stay. If there is a
    column n_chars, it follows the new text; a text that loses nothing stays as it was."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part, found in texts(batch, "body"):
                rows, dropped = part["row"], part["dropped"].to_pylist()
                new = [_kept(t, d)[0] if d else None for t, d in zip(found, dropped)]
                columns = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
                columns["text"] = pa.array([o if n is None else n for n, o in zip(new, columns["text"].to_pylist())], columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([o if n is None else len(n) for n, o in zip(new, columns["n_chars"].to_pylist())], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _joined(docs, **how).select("body", "row", "dropped").mapInArrow(run, schema)


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays, for each document."""

    def run(batches):
        for batch in batches:
            for part, found in texts(batch, "body"):
                kept = [_kept(t, d) for t, d in zip(found, part["dropped"].to_pylist())]
                sha = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in kept]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _joined(docs, **how).select(F.col("row.doc_id").cast("long").alias("doc_id"), "body", "dropped").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d),
k AS (SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, place, line, often.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
