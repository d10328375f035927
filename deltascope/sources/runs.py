"""Levelled sorted runs: a growing table of keys that is never rewritten as a whole.

Each batch adds one run: rows bucketed by key, sorted within their bucket. Once a level holds `fanout` runs they are merged into one of
the next level, so a table of n batches has some fanout * log(n) runs. A batch is joined with
the runs bucket by bucket: it is dealt out once, the runs are read where they lie, and
stored rows are shuffled only when runs are merged. Which runs count is said by a manifest that each change commits.

Batches have labels. A batch that is added again replaces its run, and the runs of the last
batch are merged only when the next one comes, so that a replay can still take them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Manifest

#: Up to so many distinct first keys a batch's keys go into the scan as literals, where Bloom
#: filters and page statistics can rule out what does not hold them; larger batches read the
#: key columns and merge. 5000 is the largest batch of the stream's rules.
LITERALS = 5000


#: Literals of one IN; Parquet takes an IN apart into a chain of that depth.
CHAIN = 200


def push_literals(spark: SparkSession) -> None:
    """Let scans of this session test chains of literals against Bloom filters and pages."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(CHAIN))


def one_of(column: str, values: Sequence[int]) -> Column:
    """column IN values, in short chains of neighbouring values, joined as a balanced tree."""
    values = sorted(values)
    parts = [F.col(column).isin(values[i : i + CHAIN]) for i in range(0, len(values), CHAIN)]
    while len(parts) > 1:
        parts = [a | b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    return parts[0]


class LevelledRuns:
    """Runs of rows (`schema`, a DDL text) under `path`, keyed by the long columns `keys`.

    `merge` gives for each other column how rows of one key become one in a compaction.
    `near`, if named, is a column that equal keys agree on and that batches are narrow in (a
    day, say): runs are sorted by it first, the manifest has their ranges of it, and a batch
    reads only its own range. With
    `lookups` runs have Bloom filters and short pages, and small batches put their keys
    into the scan."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], merge: Mapping[str, Callable[[str], Column]], near: str | None = None, buckets: int = 16, fanout: int = 4, lookups: bool = False) -> None:
        self.spark, self.path, self.schema, self.keys, self.merge = spark, path.rstrip("/"), schema, list(keys), dict(merge)
        self.near, self.fanout, self.lookups = near, fanout, lookups
        self.manifest = Manifest(spark, path)
        self.buckets = self.manifest.read()[1].get("buckets", buckets)  # as the stored runs have them

    def runs(self) -> list[dict]:
        """name, level and batches of each run, as committed."""
        return self.manifest.read()[1].get("runs", [])

    def _write(self, rows: DataFrame, level: int, batches: list[str]) -> dict:
        name = f"run_{uuid.uuid4().hex[:16]}"
        order = [c for c in (self.near, *self.keys) if c]
        dealt = rows.repartition(self.buckets, *self.keys).sortWithinPartitions(*order)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*order).option("path", f"{self.path}/{name}")
        if self.lookups:
            writer = writer.options(**{f"parquet.bloom.filter.enabled#{self.keys[0]}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.page.row.count.limit": "2000"})
        writer.option("compression", "zstd").saveAsTable(name)
        made = {"name": name, "level": level, "batches": batches}
        if self.near:
            low, high = self._table(name).agg(F.min(self.near), F.max(self.near)).first()  # from the footers
            made |= {"low": low, "high": high}
        return made

    def _table(self, name: str) -> DataFrame:
        """A run as a bucketed table; in a new session it is made known to the catalogue again."""
        if not self.spark.catalog.tableExists(name):
            by, order = ", ".join(self.keys), ", ".join(c for c in (self.near, *self.keys) if c)
            self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _drop(self, runs: list[dict]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['name']}")
            self.manifest.delete(r["name"])

    def _commit(self, version: int, runs: list[dict]) -> None:
        self.manifest.commit(version + 1, {"buckets": self.buckets, "runs": runs})
        self.manifest.drop_versions()

    def compact(self, but: str | None = None, everything: bool = False) -> None:
        """Merge full levels, from the lowest; or all runs into one. The run of the batch `but`
        stays as it is."""
        while True:
            version, content = self.manifest.read()
            runs = content.get("runs", [])
            free = [r for r in runs if r["batches"] != [but]]
            levels = [r["level"] for r in free]
            full = [x for x in sorted(set(levels)) if levels.count(x) >= self.fanout]
            chosen = free if everything and len(free) > 1 else [r for r in free if full and r["level"] == full[0]]
            if not chosen:
                return
            made = self._write(self._merged([r["name"] for r in chosen]), max(r["level"] for r in chosen) + 1, [b for r in chosen for b in r["batches"]])
            self._commit(version, [r for r in runs if r not in chosen] + [made])
            self._drop(chosen)

    def _merged(self, names: list[str]) -> DataFrame:
        """Rows of several runs, those of a key made one. The files are read as plain tables:
        a union of bucketed ones would be taken for bucketed, and keys left apart."""
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])
        keys = [c for c in (self.near, *self.keys) if c]
        if not self.merge:
            return rows.distinct()
        return rows.groupBy(*keys).agg(*[how(c).alias(c) for c, how in self.merge.items()]).select(*rows.columns)

    def totals(self) -> DataFrame:
        """All keys, each once, their rows merged; None runs give an empty table."""
        names = [r["name"] for r in self.runs()]
        return self._merged(names) if names else self.spark.createDataFrame([], self.schema)

    def _before(self, batch: str | None) -> list[dict]:
        """The runs of other batches, full levels merged."""
        self.compact(but=batch)
        return [r for r in self.runs() if batch is None or r["batches"] != [batch]]

    def marked(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """The rows with `known`: whether a run holds their key. One merge join a run, all in
        one stage. What the batch of this label has stored itself does not count."""
        out, found = rows.repartition(self.buckets, *self.keys), F.lit(False)
        for i, run in enumerate(self._looked_at(rows, batch)):
            out = out.join(run.withColumn(f"_in{i}", F.lit(True)), run.columns, "left")
            found = found | F.col(f"_in{i}").isNotNull()
        return out.select(*rows.columns, found.alias("known"))

    def absent(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """The rows whose key no run holds: one merge-anti-join a run, in one stage. With `near`
        or `lookups` the rows are looked at first and should be a written table."""
        fresh = rows.repartition(self.buckets, *self.keys)
        for run in self._looked_at(rows, batch):
            fresh = fresh.join(run, run.columns, "left_anti")
        return fresh

    def _looked_at(self, rows: DataFrame, batch: str | None) -> list[DataFrame]:
        """The keys of what can concern the rows: of the runs whose range of `near` meets theirs
        the part in that range, and only their keys where these are few enough for literals."""
        runs, conditions = self._before(batch), []
        if self.near:
            low, high = rows.agg(F.min(self.near), F.max(self.near)).first()
            if low is not None:
                runs = [r for r in runs if r["low"] is not None and r["low"] <= high and low <= r["high"]]
                conditions.append(F.col(self.near).between(low, high))
        if self.lookups and runs:
            first = [r[0] for r in rows.select(self.keys[0]).distinct().limit(LITERALS + 1).collect()]
            if 0 < len(first) <= LITERALS:
                conditions.append(one_of(self.keys[0], first))
        found = [self._table(r["name"]) for r in runs]
        for c in conditions:
            found = [t.where(c) for t in found]
        return [t.select(*[c for c in (self.near, *self.keys) if c]) for t in found]

    def add(self, rows: DataFrame, batch: str) -> None:
        """Store a batch's rows as a run; keys must be unique in it. Nothing is merged here, as
        the rows may come from a join with the runs."""
        version, content = self.manifest.read()
        runs = content.get("runs", [])
        replaced = [r for r in runs if r["batches"] == [batch]]
        if any(batch in r["batches"] for r in runs) and not replaced:
            raise ValueError(f"batch {batch} is merged already and cannot be replaced")
        made = self._write(rows, 0, [batch])
        self._commit(version, [r for r in runs if r not in replaced] + [made])
        self._drop(replaced)

    def drop(self) -> None:
        """Delete all runs and the manifest."""
        self._drop(self.runs())
        self.manifest.delete("")
