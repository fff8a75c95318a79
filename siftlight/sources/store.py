"""A table of texts and vectors in versions, brought up to date by content.

A version is a manifest: the segments (directories of Parquet files) that hold its rows,
and those that hold the hashes of rows that are gone. The manifest is written last, under
another name, and renamed; that makes the version visible, so readers never see half a
version and a failed job leaves the last one in place. A writer that finds another's version
after the one it began with begins anew. Ingest compares hashes of (model, text): only texts that the table lacks
are embedded and written, as a segment of their own, and of rows whose text is gone only
the hashes are. After ``SEGMENTS`` of either, and when labels are stored, all is written
anew as one segment. Rows are known by their hash; ``id`` is a number made from it.
"""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions.text import content_hash
from siftlight.operators.embed import Embedder, embed
from siftlight.sources.versions import Conflict, Versions

VERSION = 2
SEGMENTS, RETRIES = 32, 5


@dataclass(frozen=True)
class Properties:
    model_id: str
    dim: int
    schema_version: int = VERSION


@dataclass(frozen=True)
class Manifest:
    """Segments of rows, in order; segments of hashes, each with how many of the row
    segments it is about; and the number of rows."""

    properties: Properties
    rows: tuple[str, ...]
    gone: tuple[tuple[str, int], ...]
    count: int


@dataclass(frozen=True)
class Ingested:
    """What an ingest did: rows embedded, rows kept, rows dropped, different sources."""

    fresh: int
    hits: int
    stale: int
    sources: int


class Store:
    """Versions below ``root``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root)

    def exists(self) -> bool:
        return bool(self.versions.numbers())

    def manifest(self) -> Manifest | None:
        return self._at(self.versions.last())

    def _at(self, number: int) -> Manifest | None:
        if not number:
            return None
        x = self.versions.read(number)
        return Manifest(Properties(**x["properties"]), tuple(x["rows"]), tuple((a, b) for a, b in x["gone"]), x["count"])

    def properties(self) -> Properties | None:
        now = self.manifest()
        return now and now.properties

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def _read(self, now: Manifest | None) -> DataFrame:
        if now is None:
            raise FileNotFoundError(f"{self.root} has no table")
        parts = [self.spark.read.parquet(f"{self.root}/{x}") for x in now.rows]
        if now.gone:
            about = [self.spark.read.parquet(f"{self.root}/{x}").select("chunk_hash", F.lit(n).alias("_n")) for x, n in now.gone]
            gone = reduce(DataFrame.unionByName, about).groupBy("chunk_hash").agg(F.max("_n").alias("_n"))
            numbered = [x.withColumn("_at", F.lit(i)) for i, x in enumerate(parts)]
            held = reduce(DataFrame.unionByName, numbered)
            return held.join(gone.withColumnRenamed("chunk_hash", "_hash"), (F.col("chunk_hash") == F.col("_hash")) & (F.col("_at") < F.col("_n")), "left_anti").drop("_at")
        return reduce(DataFrame.unionByName, parts)

    def verify(self) -> int:
        """The number of rows; ValueError if a full scan finds another than was stored."""
        found, want = self.read().count(), self.manifest().count
        if found != want:
            raise ValueError(f"{self.root} has {found} rows, not {want}")
        return found

    def is_current(self, properties: Properties) -> bool:
        return self.properties() == properties

    def _segment(self, kind: str, rows: DataFrame, after: int) -> str:
        name = f"{kind}-{after + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def write(self, rows: DataFrame, properties: Properties, after: int | None = None) -> None:
        """The next version, of one segment. ``rows`` may come from the one before, ``after``;
        Conflict if there is another by now."""
        after = self.versions.last() if after is None else after
        name = self._segment("rows", rows, after)
        self.versions.publish(asdict(Manifest(properties, (name,), (), self.spark.read.parquet(f"{self.root}/{name}").count())), after)

    def change(self, fresh: DataFrame | None, stale: DataFrame | None, after: int | None = None) -> None:
        """The next version, with the rows ``fresh`` and without those of the hashes in
        ``stale``. Only these are written. Conflict if the table isn't at ``after`` any more."""
        after = self.versions.last() if after is None else after
        now = self._at(after)
        rows, gone, count = list(now.rows), list(now.gone), now.count
        if stale is not None:
            gone.append((self._segment("gone", stale.select("chunk_hash"), after), len(rows)))
            count -= self.spark.read.parquet(f"{self.root}/{gone[-1][0]}").count()
        if fresh is not None:
            rows.append(self._segment("rows", fresh, after))
            count += self.spark.read.parquet(f"{self.root}/{rows[-1]}").count()
        self.versions.publish(asdict(Manifest(now.properties, tuple(rows), tuple(gone), count)), after)
        if max(len(rows), len(gone)) > SEGMENTS:
            self.compact()

    def compact(self) -> None:
        after = self.versions.last()
        with contextlib.suppress(Conflict):  # the next change that gets through compacts
            self.write(self._read(self._at(after)), self._at(after).properties, after)

    def drop_old(self) -> None:
        """Only the last version stays. Segments that only older ones had go; what no version
        has may be another writer's who isn't done, and stays."""
        last = self.versions.last()
        held, old = self._at(last), set()
        for number in self.versions.numbers():
            if number != last:
                was = self._at(number)
                old |= {*was.rows, *(x for x, _ in was.gone)}
        for name in old - {*held.rows, *(x for x, _ in held.gone)}:
            self.versions.fs.delete(self.versions.path(f"{self.root}/{name}"), True)
        for number in self.versions.numbers():
            if number < last:
                self.versions.fs.delete(self.versions.path(f"{self.root}/_versions/{number:06d}.json"), False)

    def ingest(self, records: DataFrame, embedder: Embedder, reset: bool = False) -> Ingested:
        """Makes the table hold the texts of ``records`` (text[, source[, ordinal]]), each once.

        Rows that stay keep their id, source and cluster. A different model or dimension,
        or ``reset``, starts anew. If nothing changes no version is written and nothing is
        embedded."""
        for _ in range(RETRIES):
            with contextlib.suppress(Conflict):
                return self._ingest(records, embedder, reset)
        return self._ingest(records, embedder, reset)

    def _ingest(self, records: DataFrame, embedder: Embedder, reset: bool) -> Ingested:
        """One attempt, from the version that is the last when it begins."""
        properties, after = Properties(embedder.model_id, embedder.dim), self.versions.last()
        now, wanted = self._at(after), hashed(records, embedder.model_id)
        if now is None or reset or now.properties != properties:
            self.write(fresh_rows(wanted, embedder), properties, after)
            return Ingested(self.manifest().count, 0, 0, self.read().select("source").distinct().count())
        held = self._read(now).select("chunk_hash")
        marked = wanted.select("chunk_hash", "source", F.lit(1).alias("w")).join(held.withColumn("h", F.lit(1)), "chunk_hash", "full_outer")
        n = marked.agg(
            F.count_if(F.col("w").isNotNull() & F.col("h").isNull()).alias("fresh"), F.count_if(F.col("w").isNotNull() & F.col("h").isNotNull()).alias("hits"), F.count_if(F.col("w").isNull()).alias("stale"),
            F.countDistinct("source").alias("sources"), F.max(F.col("w").isNotNull() & F.col("source").isNull()).alias("unnamed"),
        ).first()
        if n["fresh"] or n["stale"]:
            fresh, _, stale = difference(wanted, held)
            self.change(fresh_rows(fresh, embedder) if n["fresh"] else None, stale if n["stale"] else None, after)
        return Ingested(n["fresh"], n["hits"], n["stale"], n["sources"] + bool(n["unnamed"]))

    def store_labels(self, labels: DataFrame) -> None:
        """The next version with ``cluster`` from (chunk_hash, cluster); all other columns stay."""
        after = self.versions.last()
        held = self._read(self._at(after))
        self.write(held.drop("cluster").join(labels.select("chunk_hash", "cluster"), "chunk_hash", "left").select(held.columns), self.properties(), after)


def hashed(records: DataFrame, model_id: str) -> DataFrame:
    """(text, source, chunk_hash), one row per text: of equal texts the source of the first,
    by ``ordinal`` within sources by name, where records have those."""
    source = F.col("source") if "source" in records.columns else F.lit(None).cast("string")
    ordinal = F.col("ordinal") if "ordinal" in records.columns else F.lit(0)
    rows = records.where("text IS NOT NULL").select("text", F.struct(source.isNull().alias("none"), source.alias("source"), ordinal.alias("ordinal")).alias("k"), content_hash(F.col("text"), model_id).alias("chunk_hash"))
    return rows.groupBy("chunk_hash").agg(F.first("text").alias("text"), F.min("k").alias("k")).select("text", "k.source", "chunk_hash")


def build_rows(spark: SparkSession, texts: list[str], vectors, model_id: str, source: str | None = None) -> DataFrame:
    """Rows of the table from texts and their vectors, one for one."""
    if len(texts) != len(vectors):
        raise ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
    given = spark.createDataFrame([(t, [float(x) for x in v], source) for t, v in zip(texts, vectors)], "text string, embedding array<float>, source string")
    return _rows(given.withColumn("chunk_hash", content_hash(F.col("text"), model_id)))


def difference(wanted: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to embed, rows that are there, and rows of the table that are wanted no more."""
    keys = held.select("chunk_hash").distinct()
    return wanted.join(keys, "chunk_hash", "left_anti"), wanted.join(keys, "chunk_hash", "left_semi"), held.join(wanted.select("chunk_hash"), "chunk_hash", "left_anti")


def fresh_rows(wanted: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows of the table: ids come from the content, so that a task that runs again gives
    the same ones."""
    return _rows(embed(wanted.select("text", "source", "chunk_hash"), embedder))


def _rows(made: DataFrame) -> DataFrame:
    identity = F.conv(F.substring("chunk_hash", 1, 15), 16, 10).cast("long")
    return made.select(identity.alias("id"), "text", "chunk_hash", "embedding", "source", F.lit(None).cast("int").alias("cluster"))


def dump_vectors(table: DataFrame, path: str) -> None:
    """Texts and vectors as JSON lines."""
    table.select("text", F.col("embedding").alias("vector")).write.mode("overwrite").json(path)
