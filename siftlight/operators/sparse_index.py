"""A BM25 index in segments, kept as documents come and go.

A segment has the postings of the documents that came with it, in blocks: of one term, and
of one group of some hundred documents of about the same length. A block knows the largest
count and the shortest document in it, so that what it can add to a score has a bound. A
segment of what is gone has ids, and how many documents each term lost. Counts, and with
them all scores, are those of the documents that are there.

A search adds up the bounds of each group, from the blocks' heads alone, scores the most
promising groups, and then those whose bound reaches the k-th score found; all others are
skipped, and nothing is lost by it (block-max pruning: Ding and Suel, 2011)."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.operators.lexical import B, DOCS, EPSILON, K1, inverted, lengths, query_terms, task_of, top
from siftlight.sources.tables import settle
from siftlight.sources.versions import Versions

BUCKETS, SPREAD, GROUP, FIRST, SEGMENTS = 64, 8, 256, 64, 32
_KEY = ["segment", "lane", "part"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _lane(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * 4).cast("int")


class SparseIndex:
    """Below ``root``, in versions; a reader has the last one, and a writer whose version
    isn't the last any more gets ``Conflict``. Ids are of any kind, those of documents that
    are there unique; a null text is empty."""

    def __init__(self, spark: SparkSession, root: str, group: int = GROUP):
        self.spark, self.root, self.group = spark, root.rstrip("/"), group
        self.versions = Versions(spark, self.root)

    def manifest(self) -> dict:
        last = self.versions.last()
        return self.versions.read(last) if last else {"segments": [], "gone": [], "n": 0, "length": 0, "kind": None, "about": None}

    def change(self, fresh: DataFrame | None, gone: DataFrame | None, about: object = None) -> None:
        """The next version: with the documents ``fresh`` (id, text) and without ``gone``
        (id, text: as it was). ``about`` is kept with the version."""
        after, now = self.versions.last(), self.manifest()
        if gone is not None:
            name = f"gone-{after + 1:06d}-{uuid.uuid4().hex[:8]}"
            rows = gone.select("id", "text")
            lengths(rows).write.parquet(f"{self.root}/{name}/ids")
            self._write_terms(inverted(rows, DOCS).groupBy("term").agg(F.sum(F.size("id")).alias("df")), name)
            lost = self.spark.read.parquet(f"{self.root}/{name}/ids").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            now["gone"].append([name, len(now["segments"])])
            now["n"], now["length"] = now["n"] - lost["n"], now["length"] - lost["length"]
        if fresh is not None:
            name = f"rows-{after + 1:06d}-{uuid.uuid4().hex[:8]}"
            rows = fresh.select("id", "text")
            lengths(rows).write.parquet(f"{self.root}/{name}/documents")
            made = inverted(rows, self.group, _lane(F.length(F.coalesce(F.col("text"), F.lit("")))))
            blocks = made.withColumn("spread", F.pmod(task_of("part"), F.lit(SPREAD)))
            self._write_blocks(self._dealt(blocks).select("term", "lane", "part", F.arrays_zip("id", "tf", "dl").alias("entries"), "most", "shortest", "bucket"), name)
            new = self.spark.read.parquet(f"{self.root}/{name}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            now["segments"].append(name)
            now["n"], now["length"], now["kind"] = now["n"] + new["n"], now["length"] + new["length"], fresh.schema["id"].dataType.simpleString()
        now["about"] = about
        self.versions.publish(now, after)
        if max(len(now["segments"]), len(now["gone"])) > SEGMENTS:
            self.merge()

    def _grouped(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of a segment's documents with the group of each: documents of about the same
        length are in a lane, and lanes fall in parts by a hash."""
        lane = _lane(F.col("dl"))
        sizes = self.spark.read.parquet(f"{self.root}/{name}/documents").groupBy(lane.alias("lane")).agg(F.count("*").alias("n")).collect()  # 130 lanes at most
        parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["lane"], max(1, math.ceil(r["n"] / self.group)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
        return rows.withColumn("lane", lane).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), parts[F.col("lane")]).cast("long"))

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """Rows with ``spread``, dealt once by that and the bucket of their term."""
        return rows.withColumn("bucket", _bucket("term")).repartition("bucket", "spread")

    def _write_blocks(self, blocks: DataFrame, name: str) -> None:
        blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/{name}/postings")
        self._write_terms(self._postings([name], None).groupBy("term").agg(F.sum(F.size("entries.tf")).alias("df")), name)

    def _write_terms(self, terms: DataFrame, name: str) -> None:
        terms.withColumn("bucket", _bucket("term")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/{name}/terms")

    def _postings(self, names: list[str], kind: str | None) -> DataFrame:
        """Blocks of some segments, which are numbered in their order."""
        kind = kind or self.spark.read.parquet(f"{self.root}/{names[0]}/documents").schema["id"].dataType.simpleString()
        schema = f"term string, lane int, part long, entries array<struct<id:{kind},tf:int,dl:int>>, most int, shortest int, bucket int"
        return _union([self.spark.read.schema(schema).parquet(f"{self.root}/{x}/postings").withColumn("segment", F.lit(i)) for i, x in enumerate(names)])

    def _terms(self, now: dict) -> DataFrame:
        """(bucket, term, df): documents that are there by term."""
        read = self.spark.read.schema("term string, df long, bucket int").parquet
        added = [read(f"{self.root}/{x}/terms") for x in now["segments"]]
        lost = [read(f"{self.root}/{x}/terms").withColumn("df", -F.col("df")) for x, _ in now["gone"]]
        return _union([*added, *lost]).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def _alive(self, rows: DataFrame, now: dict) -> DataFrame:
        """Of (segment, id, ...) those whose document isn't gone since."""
        if not now["gone"]:
            return rows
        gone = _union([self.spark.read.parquet(f"{self.root}/{x}/ids").select(F.col("id").alias("_id"), F.lit(n).alias("_n")) for x, n in now["gone"]])
        gone = gone.groupBy("_id").agg(F.max("_n").alias("_n"))
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_n")), "left_anti")

    def documents(self, now: dict | None = None) -> DataFrame:
        """(id, dl) of all that are there."""
        now = now or self.manifest()
        held = _union([self.spark.read.parquet(f"{self.root}/{x}/documents").withColumn("segment", F.lit(i)) for i, x in enumerate(now["segments"])])
        return self._alive(held, now).select("id", "dl")

    def merge(self) -> None:
        """One segment instead of many, without what is gone. Texts aren't read."""
        after, now = self.versions.last(), self.manifest()
        name = f"rows-{after + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows = self._postings(now["segments"], now["kind"]).select("segment", "term", F.explode("entries").alias("x")).select("segment", "term", "x.id", "x.tf", "x.dl")
        self.documents(now).write.parquet(f"{self.root}/{name}/documents")
        rows = self._grouped(self._alive(rows, now).drop("segment"), name).withColumn("spread", F.pmod(F.xxhash64("lane", "part"), F.lit(SPREAD)))
        # A block has as many entries as its group has documents, at most.
        entries = F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("entries")
        blocks = self._dealt(rows).groupBy("bucket", "spread", "term", "lane", "part").agg(entries, F.max("tf").alias("most"), F.min("dl").alias("shortest"))
        self._write_blocks(blocks.drop("spread"), name)
        self.versions.publish({**now, "segments": [name], "gone": []}, after)

    def search(self, query: str, k: int, drop_zero: bool = False, told: dict | None = None) -> DataFrame:
        """(id, score, rank): the k best; documents without a query term fill up what is left,
        by id, unless they are to be dropped. ``told`` gets how many groups there were, and
        how many were skipped."""
        if k < 1:
            raise ValueError("k must be at least 1")
        now, wanted = self.manifest(), Counter(query_terms(self.spark, query))
        if not now["segments"]:
            return self.spark.createDataFrame([], "id string, score double, rank long")
        buckets = [r["b"] for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket("t").alias("b")).distinct().collect()] if wanted else []
        named = F.col("term").isin(list(wanted)) & F.col("bucket").isin(buckets)
        dfs = {r["term"]: r["df"] for r in self._terms(now).where(named).collect()}
        n, mean_length = now["n"], now["length"] / max(1, now["n"])
        idfs = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in dfs.items()}
        floor = 0.0
        if min(idfs.values(), default=0.0) < 0:
            floor = EPSILON * (self._terms(now).agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0)
        weights = {t: wanted[t] * (idf if idf >= 0 else floor) for t, idf in idfs.items()}
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()], F.lit(0.0))
        gain = lambda tf, dl: F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(max(mean_length, 1e-9))))
        blocks = self._postings(now["segments"], now["kind"]).where(named)
        # The heads of blocks; their entries aren't read.
        heads = blocks.select(*_KEY, (F.greatest(weight, F.lit(0.0)) * gain("most", "shortest")).alias("bound"))
        groups = settle(heads.groupBy(*_KEY).agg(F.sum("bound").alias("bound")))

        def scored(some: DataFrame) -> DataFrame:
            rows = blocks.join(some.select(*_KEY), _KEY, "left_semi").select("segment", "term", F.explode("entries").alias("x")).select("segment", "term", "x.id", "x.tf", "x.dl")
            return self._alive(rows, now).groupBy("id").agg(F.sum(weight * gain("tf", "dl")).alias("score"))

        first = settle(groups.orderBy(F.desc("bound"), *_KEY).limit(FIRST))
        found = settle(top(scored(F.broadcast(first)), k).select("id", "score"))
        reached = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = reached["least"] - 1e-6 if reached["n"] >= k else -math.inf
        rest = groups.join(F.broadcast(first.select(*_KEY)), _KEY, "left_anti")
        if told is not None:
            told["groups"], told["skipped"] = groups.count(), rest.where(F.col("bound") < least).count()
        scores = found.unionByName(scored(rest.where(F.col("bound") >= least)))
        if min(weights.values(), default=0.0) < 0:  # nearly all terms are in over half: no score may give way to a zero
            scores = scored(groups)
        if not drop_zero:
            others = self.documents(now).join(scores.select("id"), "id", "left_anti").orderBy("id").limit(k)
            scores = scores.unionByName(others.select("id", F.lit(0.0).alias("score")))
        return top(scores, k)


def refreshed(store, root: str | None = None) -> SparseIndex:
    """The index of a store's texts by chunk_hash, brought to the store's last version: only
    segments that came since are cut. A store that was written anew is indexed anew."""
    index = SparseIndex(store.spark, root or f"{store.root}/_sparse")
    now, seen = store.manifest(), index.manifest()["about"]
    read = lambda x: store.spark.read.parquet(f"{store.root}/{x}")
    about = {"rows": list(now.rows), "gone": [list(x) for x in now.gone]}
    if seen == about:
        return index
    if seen is None or seen["rows"] != about["rows"][: len(seen["rows"])] or seen["gone"] != about["gone"][: len(seen["gone"])]:
        after = index.versions.last()
        if after:
            index.versions.publish({"segments": [], "gone": [], "n": 0, "length": 0, "kind": None, "about": None}, after)
        index.change(store.read().select(F.col("chunk_hash").alias("id"), "text"), None, about)
        return index
    # What each version dropped went before what it added.
    rows = {"rows": list(seen["rows"]), "gone": list(seen["gone"])}
    for name, upto in about["gone"][len(seen["gone"]) :]:
        for x in about["rows"][len(rows["rows"]) : upto]:
            rows["rows"].append(x)
            index.change(read(x).select(F.col("chunk_hash").alias("id"), "text"), None, {k: list(v) for k, v in rows.items()})
        rows["gone"].append([name, upto])
        was = _union([read(x).select("chunk_hash", "text") for x in about["rows"][:upto]]).join(read(name), "chunk_hash", "left_semi").dropDuplicates(["chunk_hash"])
        index.change(None, was.select(F.col("chunk_hash").alias("id"), "text"), {k: list(v) for k, v in rows.items()})
    for x in about["rows"][len(rows["rows"]) :]:
        rows["rows"].append(x)
        index.change(read(x).select(F.col("chunk_hash").alias("id"), "text"), None, {k: list(v) for k, v in rows.items()})
    return index
