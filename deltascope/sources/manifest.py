"""Versioned manifests: small JSON files that say which data files a stored table consists of.

A commit writes `_manifest-<version>.json` under a name that must not exist yet, by renaming
a finished file. Readers take the highest version, so they see a commit whole or not at
all; of two writers that start from the same version the second gets a Conflict and may
try again from what the first has left. Data files of a writer that died before its
commit are named by no manifest and are never read.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import SparkSession

DIGITS = 10
#: Local file systems check and rename in two steps: writers of this process take turns.
_TURN = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The highest committed version; 0 where nothing was ever committed."""
        found = self._fs.globStatus(self._at("_manifest-*.json")) or []
        return max([0, *(int(f.getPath().getName()[10 : 10 + DIGITS]) for f in found)])

    def read(self) -> tuple[int, dict]:
        version = self.version()
        if not version:
            return 0, {}
        stream = self._fs.open(self._at(f"_manifest-{version:0{DIGITS}d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Make `content` version `version`, which must be one above the version it was made from."""
        staged, final = self._at(f"_staged-{uuid.uuid4().hex}"), self._at(f"_manifest-{version:0{DIGITS}d}.json")
        out = self._fs.create(staged, True)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            with _TURN:
                rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), plain)
        except Exception as e:
            self._fs.delete(staged, False)
            if self._fs.exists(final):
                raise Conflict(f"{final} is committed") from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def files(self, pattern: str) -> list[str]:
        """Paths below the folder that match a pattern."""
        root = self._fs.makeQualified(self._at("")).toString().rstrip("/") + "/"
        return [f.getPath().toString().removeprefix(root) for f in self._fs.globStatus(self._at(pattern)) or []]

    def drop_versions(self, keep: int = 2) -> None:
        """Delete all but the last manifests."""
        last = self.version()
        for f in self._fs.globStatus(self._at("_manifest-*.json")) or []:
            if int(f.getPath().getName()[10 : 10 + DIGITS]) <= last - keep:
                self._fs.delete(f.getPath(), False)
