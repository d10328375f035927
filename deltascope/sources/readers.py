"""Reading business tables: files by extension, row numbers, guards, samples, demo data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quoted import OPTIONS, read_quoted
from .scratch import materialise


def read_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A table by its extension, from any file system that Spark reads. CSV has a header
    and gives strings as they stand: no type inference, spaces kept, quotes doubled,
    records over several lines, short rows filled with nulls, blank lines skipped. Large
    files are read by many tasks, after one pass that finds where records begin; without
    `multi_line` (no line feeds in cells) that pass is left out."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        if multi_line:
            return read_quoted(spark, path, "_record").drop("_record")
        df = spark.read.options(header=True, encoding="UTF-8", **OPTIONS).csv(path)
        return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    if kind in (".json", ".jsonl"):
        return spark.read.json(path, primitivesAsString=True)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {kind or 'files without extension'}: csv, json and parquet are read")


def read_numbered(spark: SparkSession, path: str, name: str = "row_number") -> DataFrame:
    """A table with its rows numbered from 1 in source order. For CSV the numbers come with the
    places of the records, so the rows are not written first."""
    if os.path.splitext(path.rstrip("/"))[1].lower() == ".csv":
        return read_quoted(spark, path, name)
    return with_row_number(read_table(spark, path), name)


def with_row_number(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Consecutive numbers from 1 in source order. Partitions are counted first, then each
    numbers its rows from its base; one number a partition reaches the driver. The rows are
    written once with their places, as another run may cut partitions otherwise."""
    base = materialise(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    counted = base.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, at = [], 0
    for r in counted:
        starts.append((r.p, at))
        at += r.n
    table = df.sparkSession.createDataFrame(starts, "_p long, _start long")  # one row a source partition
    out = base.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(table), "_p")
    number = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number.cast("long")).drop("_id", "_p", "_start")


def check_source(df: DataFrame, most: int | None = None) -> DataFrame:
    """The table, if it has rows and not more than `most`; at most that many are counted."""
    if df.isEmpty():
        raise ValueError("the source has no rows")
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"the source has more than {most} rows")
    return df


def profile_sample(rows: DataFrame, n: int | None = None, order: str = "row_number") -> DataFrame:
    """The rows whose values tell the columns' kinds and the order of days and months: all of
    them, as a table that is sorted by source or date has other notations further on. With
    a number, the first n rows."""
    return rows if n is None else rows.where(F.col(order) <= n)


def demo_sales(spark: SparkSession) -> DataFrame:
    """Half a year of monthly sales by product and region with a known answer: in the last
    month shirts on the East Coast fall by 4000. With one exact copy, one outlier and one
    missing amount."""
    products, regions = ["Shirts", "Shoes", "Hats"], ["East Coast", "West Coast", "Midwest"]
    grid = spark.range(54).select((F.col("id") / 9).cast("int").alias("month"), (F.col("id") / 3 % 3).cast("int").alias("p"), (F.col("id") % 3).cast("int").alias("r"), "id")
    amount = 4200 + 185 * (F.col("month") + 1) + 330 * F.col("p") + 240 * F.col("r") - F.when((F.col("month") == 5) & (F.col("p") == 0) & (F.col("r") == 0), 4000).otherwise(0)
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)
    own = grid.select(
        "id", F.format_string("%02d/15/2026", F.col("month") + 1).alias("Order Date"), F.concat(F.lit("$"), F.format_number(amount.cast("double"), 2)).alias("Revenue"),
        pick(products, "p").alias("Product"), pick(regions, "r").alias("Region"), F.when(F.col("id") % 2 == 0, "Online").otherwise("Retail Store").alias("Channel"),
        F.format_string("Client %d", F.col("id") % 7 + 1).alias("Customer"), F.format_string("ORD-%d", 1001 + F.col("id")).alias("Order ID"),
    )
    row = own.where("id = 4")
    odd = own.where("id = 22").withColumns({"Revenue": F.lit("$28,000.00"), "Order ID": F.lit("ORD-2001"), "Order Date": F.lit("03/20/2026")})
    none = own.where("id = 49").withColumns({"Revenue": F.lit("N/A"), "Order ID": F.lit("ORD-2002")})
    return own.unionByName(row.withColumn("id", F.lit(54).cast("long"))).unionByName(odd.withColumn("id", F.lit(55).cast("long"))).unionByName(none.withColumn("id", F.lit(56).cast("long"))).orderBy("id").drop("id")


def scale_rows(spark: SparkSession, n: int) -> DataFrame:
    """n rows of five columns by modulus, for measuring reads."""
    i = F.col("id")
    return spark.range(n).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 730).cast("int")), "yyyy-MM-dd").alias("Transaction Date"),
        F.format_string("%.2f", (i % 100000 / 7.0)).alias("Revenue"), F.format_string("Region %d", i % 12).alias("Region"),
        F.format_string("Product %d", i % 48).alias("Product"), F.format_string("Customer %d", i % 5000).alias("Customer"),
    )
