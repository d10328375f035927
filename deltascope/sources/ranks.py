"""Exact quartiles of a growing table, from what each batch left behind.

A batch's values are counted, sorted and cut into zones; of each zone its column, least and
greatest value and number of rows are stored beside the values. Zones of all batches together
bound every rank: the rows of zones that begin below a value are the most that can lie
below it, those of zones that end at it or before the fewest that do not lie above. So a rank
lies in a bracket that the zones alone tell, the zones below count without being read, and
only values of zones that reach into the bracket are. Old rows are never read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifest import Conflict, Manifest

VALUES, ZONES = "column string, value double, k long, zone long", "column string, zone long, low double, high double, k long"
#: Different values of one zone.
ZONE = 10_000
QUARTERS = (0.25, 0.75)


class RankStore:
    def __init__(self, spark: SparkSession, path: str, zone: int = ZONE) -> None:
        self.spark, self.path, self.zone = spark, path.rstrip("/"), zone
        self.manifest = Manifest(spark, path)

    def add(self, long: DataFrame, batch: str) -> None:
        """Store the values (column, value; nulls aside) of a batch; another time under the
        same label they replace what it has stored."""
        name = f"batch-{uuid.uuid4().hex[:16]}"
        counts = long.where("value is not null").groupBy("column", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("k"))
        place = F.monotonically_increasing_id()  # the task and, in the lower 33 bits, the row
        task, row = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
        dealt = counts.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
        dealt.withColumn("zone", F.shiftleft(task, 33) + F.floor(row / self.zone)).write.parquet(f"{self.path}/{name}/values")
        values = self._read(VALUES, [f"{name}/values"])
        zones = values.groupBy("column", "zone").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("k").alias("k"))
        zones.write.parquet(f"{self.path}/{name}/zones")
        while True:
            version, content = self.manifest.read()
            before = content.get("batches", {})
            try:
                self.manifest.commit(version + 1, {"batches": before | {batch: name}})
                break
            except Conflict:
                continue
        if batch in before:
            self.manifest.delete(before[batch])

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        """Rows of several batches, with the number of theirs."""
        out = self.spark.createDataFrame([], f"{schema}, of int")
        for i, f in enumerate(folders):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{f}").withColumn("of", F.lit(i)))
        return out

    def brackets(self) -> DataFrame:
        """For each rank that a quartile hangs on: column, n, rank, lo and hi, between which
        its value lies, and the rows of zones that lie wholly below (`below`)."""
        names = list(self.manifest.read()[1].get("batches", {}).values())
        zones = self._read(ZONES, [f"{x}/zones" for x in names])
        n = zones.groupBy("column").agg(F.sum("k").alias("n"))
        at = lambda f: (F.col("n") - 1) * f
        ranks = F.array_distinct(F.array(*[g(at(f)).cast("long") for f in QUARTERS for g in (F.floor, F.ceil)]))
        asked = n.select("column", "n", F.explode(ranks).alias("rank"))  # at most four a column
        starts = zones.groupBy("column", F.col("low").alias("v")).agg(F.sum("k").alias("k"))
        ends = zones.groupBy("column", F.col("high").alias("v")).agg(F.sum("k").alias("k"))
        by_value = Window.partitionBy("column").orderBy("v")  # a row a zone
        starts = starts.withColumn("most", F.sum("k").over(by_value) - F.col("k"))
        ends = ends.withColumn("fewest", F.sum("k").over(by_value))
        lo = asked.join(starts, "column").where(F.col("most") <= F.col("rank")).groupBy("column", "n", "rank").agg(F.max("v").alias("lo"))
        hi = asked.join(ends, "column").where(F.col("fewest") > F.col("rank")).groupBy("column", "rank").agg(F.min("v").alias("hi"))
        found = lo.join(hi, ["column", "rank"])
        below = found.join(zones.select("column", "high", "k"), "column").groupBy("column", "n", "rank", "lo", "hi")
        return below.agg(F.coalesce(F.sum(F.when(F.col("high") < F.col("lo"), F.col("k"))), F.lit(0)).alias("below"))

    def looked_at(self, brackets: DataFrame) -> DataFrame:
        """column, n, rank, below, value and k of the zones that reach into each rank's bracket."""
        names = list(self.manifest.read()[1].get("batches", {}).values())
        zones = self._read(ZONES, [f"{x}/zones" for x in names])
        meets = zones.join(brackets, "column").where((F.col("high") >= F.col("lo")) & (F.col("low") <= F.col("hi")))
        chosen = meets.select("of", "column", "zone", "n", "rank", "below", "low", "high")
        # the ranges of the zones as literals, which row groups are skipped by: a few a column
        spans = meets.groupBy("column", "rank").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        inside = F.lit(False)
        for s in spans:
            inside = inside | ((F.col("column") == s.column) & F.col("value").between(s.low, s.high))
        values = self._read(VALUES, [f"{x}/values" for x in names]).where(inside)
        return values.join(chosen.drop("low", "high"), ["of", "column", "zone"]).select("column", "n", "rank", "below", "value", "k")

    def quartiles(self) -> DataFrame:
        """column, n, q1 and q3 of all batches' values, exactly, interpolated at (n - 1) / 4 and
        three times that."""
        rows = self.looked_at(self.brackets()).groupBy("column", "n", "rank", "below", "value").agg(F.sum("k").alias("k"))
        upto = F.col("below") + F.sum("k").over(Window.partitionBy("column", "rank").orderBy("value"))
        placed = rows.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
        found = placed.groupBy("column", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))

        def quartile(f: float) -> Column:
            at = (F.col("n") - 1) * f
            low, high = (F.element_at("v", g(at).cast("long")) for g in (F.floor, F.ceil))
            return low + (high - low) * (at - F.floor(at))

        return found.select("column", "n", *[quartile(f).alias(q) for f, q in zip(QUARTERS, ("q1", "q3"))])
