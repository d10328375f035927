"""Ingestion in micro-batches of files: novel rows and running totals.

No event time is involved: batches are files, duplicates are found by row signature
against what earlier batches stored, and totals are written by batch number, so a
replayed batch replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.aggregate import KEYS, segment_totals
from ..operators.review import row_signature
from ..sources.runs import LevelledRuns, push_literals
from ..sources.scratch import discard, materialise
from ..sources.store import write_totals


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


SIGNATURES = "near long, k1 long, k2 long"
#: Stands for a missing day.
NO_DAY = -(1 << 40)


def signature_store(spark: SparkSession, path: str, buckets: int = 8) -> LevelledRuns:
    """The signatures of stored rows as levelled sorted runs: 128 bits of each, filed by day."""
    return LevelledRuns(spark, path, SIGNATURES, ["k1", "k2"], {}, near="near", buckets=buckets, lookups=True)


def signature_keys(rows: DataFrame, day: str | None = None) -> DataFrame:
    """The rows with the keys of their row_signature and, in `near`, their day. Rows of one
    signature have one day only if the day is among what is signed; else give none."""
    number = lambda first: F.conv(F.substring("row_signature", first, 16), 16, -10).cast("long")
    near = F.coalesce(F.unix_date(F.col(day).cast("date")).cast("long"), F.lit(NO_DAY)) if day else F.lit(0).cast("long")
    return rows.withColumns({"near": near, "k1": number(1), "k2": number(17)})


def ingest(stream: DataFrame, path: str, checkpoint: str, columns: Sequence[str], order: str = "row_number", totals: str | None = None, metric: str | None = None, date: str | None = None, dims: Sequence[str] = (), import_id: str = "stream", buckets: int = 8) -> StreamingQuery:
    """Store each batch's rows with row_signature, exact_duplicate and excluded under its
    batch number, and its totals if `totals` names a path.

    Signatures are stored by themselves as levelled sorted runs beside the rows. A batch
    reads only the runs and pages of its own days, and of these only what Bloom filters and
    page statistics do not rule out; stored rows are not read. A replayed batch replaces its
    rows, its totals and its run."""
    seen = f"{path.rstrip('/')}__signatures"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the query's own copy of the session
        push_literals(spark)
        store, key = signature_store(spark, seen, buckets), ["near", "k1", "k2"]
        signed = materialise(signature_keys(batch.withColumn("row_signature", row_signature(list(columns))), date if date in columns else None), "batch")
        first = materialise(signed.groupBy(*key).agg(F.min(order).alias("_first")), "batch-keys")
        fresh = materialise(store.absent(first.select(*key), str(number)), "batch-fresh")
        known = first.join(fresh.withColumn("_fresh", F.lit(True)), key, "left")
        duplicate = (F.col(order) != F.col("_first")) | F.col("_fresh").isNull()
        had = F.col("excluded") if "excluded" in batch.columns else F.lit(False)
        flagged = signed.join(known, key).withColumn("exact_duplicate", duplicate).withColumn("excluded", had | F.col("exact_duplicate"))
        flagged = materialise(flagged.drop(*key, "_first", "_fresh"), "batch-flagged")
        flagged.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if totals:
            write_totals(segment_totals(flagged, metric, date, dims), totals, import_id, str(number))
        store.add(fresh, str(number))
        discard(signed, first, fresh, flagged)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def novel_stream(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The stream's rows whose signature was not seen before. State holds every signature;
    bound it by the source's retention."""
    return stream.withColumn("row_signature", row_signature(columns)).dropDuplicates(["row_signature"])


def running_totals(stream: DataFrame, metric: str, date: str, dims: Sequence[str]) -> DataFrame:
    """Totals as a streaming aggregation, for the complete or update mode."""
    return segment_totals(stream, metric, date, dims)


def keep_totals(stream: DataFrame, path: str, checkpoint: str, metric: str, date: str, dims: Sequence[str], import_id: str = "stream") -> StreamingQuery:
    """Running totals as a stateful query in update mode: the state (in RocksDB, restored
    from the checkpoint after a restart) holds every segment's sum, a batch writes only the
    segments that it changed, under its number. `latest_totals` reads them."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def one(changed: DataFrame, number: int) -> None:
        write_totals(changed, path, import_id, str(number))

    totals = running_totals(stream, metric, date, dims)
    return totals.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, path: str, import_id: str = "stream") -> DataFrame:
    """Of what keep_totals has written the newest total of each segment."""
    kept = spark.read.parquet(path).where(F.col("import_id") == import_id)
    newest = F.max_by(F.struct("metric_total", "record_count"), F.col("batch").cast("long")).alias("t")
    return kept.groupBy(*KEYS).agg(newest).select(*KEYS, F.col("t.metric_total").cast("decimal(24,4)").alias("metric_total"), "t.record_count")
