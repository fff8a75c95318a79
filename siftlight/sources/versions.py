"""Numbered versions of a table's manifest, each there whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has published the version that this one meant to."""


class Versions:
    """JSON files ``_versions/NNNNNN.json`` below ``root``, in any file system that Spark
    reads. A version is written under a name of its own and then renamed, which does not
    overwrite: a reader sees whole versions only, and of two writers from the same version
    one gets ``Conflict``. (Where a rename isn't atomic, as in object stores, writers must
    take turns.)"""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_java = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._fs_java.Path(name)

    def numbers(self) -> list[int]:
        where = self.path(f"{self.root}/_versions")
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def last(self) -> int:
        return (self.numbers() or [0])[-1]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/_versions/{number:06d}.json", wholetext=True).first()["value"])

    def publish(self, content: dict, after: int) -> int:
        """The version after ``after``; Conflict if there is one."""
        if self.last() != after:
            raise Conflict(f"{self.root} has a version after {after}")
        new, own = self.path(f"{self.root}/_versions/{after + 1:06d}.json"), self.path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        kept = self.fs.makeQualified(own), self.fs.makeQualified(new)
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._fs_java.FileContext.getFileContext(kept[1].toUri(), self._conf).rename(*kept, options)
        except Exception as e:
            if self.fs.exists(own):
                self.fs.delete(own, False)
            if self.fs.exists(new):
                raise Conflict(f"{self.root} has a version after {after}") from e
            raise
        return after + 1
