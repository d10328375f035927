"""Stored imports: review rows and totals as partitioned Parquet, previews, export, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import KEYS, merge_totals
from .versioned import StoredImport


def _overwrite(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_rows(rows: DataFrame, path: str, import_id: str, files: int | None = None) -> None:
    """Write the review rows of an import; another write of the same import replaces it."""
    StoredImport(rows.sparkSession, path, import_id).write(rows, files)


def upsert_rows(spark: SparkSession, rows: DataFrame, path: str, import_id: str) -> None:
    """Replace the stored rows of the same row numbers and add the others: one delta, no
    stored row is written again."""
    StoredImport(spark, path, import_id).upsert(rows)


def read_rows(spark: SparkSession, path: str, import_id: str, ordered: bool = True) -> DataFrame:
    """The rows of one import (only its folder is read), in row order."""
    out = StoredImport(spark, path, import_id).rows()
    return out.orderBy("row_number") if ordered else out


def get_row(spark: SparkSession, path: str, import_id: str, row_number: int) -> DataFrame:
    """One row; the zone map names the files that can hold it."""
    return StoredImport(spark, path, import_id).rows(row_number, row_number)


def stored_page(spark: SparkSession, path: str, import_id: str, page: int = 0, size: int = 100) -> DataFrame:
    """A page of a stored import, from the files that it lies in."""
    return StoredImport(spark, path, import_id).page(page, size)


def preview(rows: DataFrame, page: int = 0, size: int = 100) -> DataFrame:
    """A page of rows that are not stored, with the number of all rows (total_rows); a page is
    at least 0, its size between 1 and 200. Stored rows have `stored_page`."""
    page, size = max(0, int(page)), max(1, min(int(size), 200))
    total = rows.agg(F.count("*").alias("total_rows"))
    return rows.orderBy("row_number").offset(page * size).limit(size).join(F.broadcast(total))


def write_totals(totals: DataFrame, path: str, import_id: str, batch: str = "all") -> None:
    """Write a batch's totals. A batch that is written again replaces itself, so a replay
    does not count twice."""
    _overwrite(totals.withColumns({"import_id": F.lit(import_id), "batch": F.lit(batch)}), path, "import_id", "batch")


def read_totals(spark: SparkSession, path: str, import_id: str) -> DataFrame:
    """An import's totals over all its batches, added up."""
    return merge_totals(spark.read.parquet(path).where(F.col("import_id") == import_id).select(*KEYS, "metric_total", "record_count"))


def reset_import(spark: SparkSession, path: str, import_id: str) -> None:
    """Drop the stored partition of an import."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/import_id={import_id}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def export_rows(review: DataFrame, columns: list[str]) -> DataFrame:
    """The cleaned columns with a status for each row."""
    status = F.when(F.col("exact_duplicate"), "Excluded: exact duplicate").when(F.col("excluded"), "Excluded").when(F.col("possible_duplicate"), "Possible duplicate").otherwise("Included")
    return review.select("row_number", *columns, status.alias("__status"))


def append_run(run: DataFrame, path: str) -> None:
    """Append a run (metric_column, dimension, segment, periods, totals, created_at)."""
    run.write.mode("append").parquet(path)


def recent_runs(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("created_at"), F.desc("current_period")).limit(n)
