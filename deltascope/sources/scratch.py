"""Tables written to the shared folder in mid-plan, so that what follows (and retries after
a lost executor) starts from files instead of computing the same rows again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or "file:///tmp/checkpoints"  # all of Spark is on one machine
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise wrote, once nothing will read them again."""
    for t in tables:
        p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch)
        p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """The table in at least as many partitions as there are cores. A table that has them
    already is left alone; only a small one (few files, few row groups) is dealt out, so
    that costly expressions do not run in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
