"""Stored imports that are changed row by row: merge-on-read under a versioned manifest.

The rows of an import lie in base files, each with its own range of row numbers, and in delta
files that upserts add. The manifest names them, with the range and the rows of each (a zone
map) and the order of the deltas. An upsert writes its rows and commits; it reads nothing
but the keys in its range and rewrites nothing. A reader takes, of base and deltas, the newest row
of each number. `compact` folds deltas into those base files whose range they touch. Keys are
joined by sorting, not broadcast: an upsert may be as large as a share of all rows, and its
keys compress so well that Spark would take them for small.

Two writers that meet are put in order by their commits: the later one tries again on the new
version, so both sets of rows stay, and for a row that both bring the later commit counts.
What a writer that died has written is in no manifest; `vacuum` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .manifest import Conflict, Manifest

FIRST, LAST = -(1 << 63), (1 << 63) - 1


class StoredImport:
    def __init__(self, spark: SparkSession, path: str, import_id: str, key: str = "row_number") -> None:
        self.spark, self.key = spark, key
        self.folder = f"{path.rstrip('/')}/import_id={import_id}"
        self.manifest = Manifest(spark, self.folder)

    # writing

    def _put(self, rows: DataFrame, kind: str, files: int | None = None) -> list[dict]:
        """Write rows in files of separate ranges of the key; the entries of the files."""
        name = f"set={kind}-{uuid.uuid4().hex[:16]}"
        dealt = rows.repartitionByRange(files, self.key) if files else rows.repartitionByRange(self.key)
        dealt.sortWithinPartitions(self.key).write.parquet(f"{self.folder}/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")
        zones = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        return [{"file": f"{name}/{r.file}", "low": r.low, "high": r.high, "rows": r.rows} for r in sorted(zones.collect(), key=lambda r: r.low)]  # a row a file

    def write(self, rows: DataFrame, files: int | None = None) -> None:
        """Put these rows in the place of all that is stored."""
        base = self._put(rows, "base", files)
        while True:
            version, _ = self.manifest.read()
            try:
                return self.manifest.commit(version + 1, {"schema": rows.schema.json(), "base": base, "deltas": []})
            except Conflict:
                continue

    def upsert(self, rows: DataFrame, files: int | None = 1) -> None:
        """Replace the stored rows of these numbers and add the others; a number stands once in
        `rows`. The files of an upsert are few unless `files` says otherwise; None lets their
        number follow the rows."""
        version, content = self.manifest.read()
        if not content:
            return self.write(rows, files)
        schema = StructType.fromJson(json.loads(content["schema"]))
        made = self._put(rows.select(*schema.names), "delta", files)
        while True:
            version, content = self.manifest.read()
            delta = {"files": made, "seq": version + 1, "inserted": self._inserted(content, made)}
            try:
                return self.manifest.commit(version + 1, content | {"deltas": [*content["deltas"], delta]})
            except Conflict:
                continue

    def _inserted(self, content: dict, files: list[dict]) -> dict[str, int]:
        """How many rows of these files are new, by the base file whose range they fall into."""
        if not files:
            return {}
        low, high = min(f["low"] for f in files), max(f["high"] for f in files)
        keys = self._read(content, [f["file"] for f in files]).select(self.key)
        new = keys.join(self._current(content, low, high).select(self.key).hint("merge"), self.key, "left_anti")
        found = new.groupBy(_owner(F.col(self.key), content).alias("owner")).agg(F.count("*").alias("n")).collect()  # a row a file at most
        return {str(r.owner): r.n for r in found}

    # reading

    def _read(self, content: dict, files: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in files])

    def _current(self, content: dict, low: int = FIRST, high: int = LAST) -> DataFrame:
        """The newest rows whose numbers lie between low and high; files outside are not opened."""
        meets = lambda f: f["low"] <= high and low <= f["high"]
        inside = F.col(self.key).between(low, high)
        base = self._read(content, [f["file"] for f in content["base"] if meets(f)]).where(inside)
        deltas = None
        for d in content["deltas"]:
            files = [f["file"] for f in d["files"] if meets(f)]
            if files:
                one = self._read(content, files).where(inside).select(self.key, F.struct(F.lit(d["seq"]).alias("seq"), F.struct("*").alias("row")).alias("_new"))
                deltas = one if deltas is None else deltas.unionByName(one)
        if deltas is None:
            return base
        newest = deltas.groupBy(self.key).agg(F.max_by("_new.row", "_new.seq").alias("_row"))
        return base.join(newest.select(self.key).hint("merge"), self.key, "left_anti").unionByName(newest.select("_row.*"))

    def rows(self, low: int = FIRST, high: int = LAST) -> DataFrame:
        version, content = self.manifest.read()
        if not version:
            raise ValueError(f"nothing is stored in {self.folder}")
        return self._current(content, low, high)

    def page(self, page: int = 0, size: int = 100) -> DataFrame:
        """A page of the rows in order, with the number of all rows (total_rows); a page is at
        least 0, its size between 1 and 200. The zone map says in which files the page lies."""
        page, size = max(0, int(page)), max(1, min(int(size), 200))
        _, content = self.manifest.read()
        counts = [f["rows"] for f in content["base"]] or [0]
        for d in content["deltas"]:
            for owner, n in d["inserted"].items():
                counts[int(owner)] += n
        offset, before, first = page * size, 0, 0
        while first < len(counts) - 1 and before + counts[first] <= offset:
            before, first = before + counts[first], first + 1
        last, upto = first, before + counts[first]
        while last < len(counts) - 1 and upto < offset + size:
            last, upto = last + 1, upto + counts[last + 1]
        low = FIRST if first == 0 else content["base"][first]["low"]
        high = LAST if last == len(counts) - 1 else content["base"][last + 1]["low"] - 1
        few = self._current(content, low, high).orderBy(self.key).offset(offset - before).limit(size)
        return few.withColumn("total_rows", F.lit(sum(counts)).cast("long"))

    # upkeep

    def compact(self) -> bool:
        """Fold the deltas into the base files that they touch; False if another writer was
        faster with the same. Upserts that come meanwhile stay deltas."""
        version, content = self.manifest.read()
        deltas = content["deltas"]
        if not deltas:
            return True
        touched = sorted({i for d in deltas for f in d["files"] for i in range(_place(f["low"], content), _place(f["high"], content) + 1)})
        base = [f for i, f in enumerate(content["base"]) if i not in touched]
        for a, b in _runs(touched):
            low = FIRST if a == 0 else content["base"][a]["low"]
            high = LAST if b >= len(content["base"]) - 1 else content["base"][b + 1]["low"] - 1
            base += self._put(self._current(content, low, high), "base", b - a + 1)
        base.sort(key=lambda f: f["low"])
        while True:
            version, now = self.manifest.read()
            if now["base"] != content["base"]:
                return False
            later = [d for d in now["deltas"] if d["seq"] > deltas[-1]["seq"]]
            made = {"schema": content["schema"], "base": base, "deltas": []}
            for d in later:
                made["deltas"].append(d | {"inserted": self._inserted(made, d["files"])})
            try:
                self.manifest.commit(version + 1, made)
                return True
            except Conflict:
                continue

    def vacuum(self) -> list[str]:
        """Delete files that the newest manifest does not name. Not while others read older
        versions or write."""
        _, content = self.manifest.read()
        named = {f["file"] for f in content.get("base", [])} | {f["file"] for d in content.get("deltas", []) for f in d["files"]}
        gone = [f for f in self.manifest.files("set=*/part-*.parquet") if f not in named]
        for f in gone:
            self.manifest.delete(f)
        self.manifest.drop_versions(1)
        return gone


def _place(number: int, content: dict) -> int:
    """The base file whose range a number falls into; the first also has all numbers before it."""
    return max([0, *(i for i, f in enumerate(content["base"]) if f["low"] <= number)])


def _owner(number: Column, content: dict) -> Column:
    lows = [f["low"] for f in content["base"][1:]]
    return F.size(F.filter(F.array(*map(F.lit, lows)).cast("array<bigint>"), lambda low: low <= number)) if lows else F.lit(0)


def _runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out
