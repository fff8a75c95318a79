"""Nearest vectors by walks over proximity graphs.

All vectors are dealt to shards by a hash. A shard is one row of a table: its ids, vectors
and links, where each vector is linked to near ones that differ in direction, as in Vamana
(Subramanya et al., 2019): of two that lie close to each other only the nearer is linked,
then links go back too, a few lead anywhere, and the nearest of the rest fill up. A search
enters a shard at the best of some vectors and goes on from the best it has seen, ``ef`` of
which it keeps. Conditions hold during the walk: it passes through rows that don't meet them
and keeps those that do."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.operators.dense import _dim, _sound
from siftlight.operators.neighbours import matrix
from siftlight.sources.tables import settle

LINKS, POOL, ALPHA, ANYWHERE, EF = 32, 64, 1.2, 2, 128
SHARD_BYTES, LEAST_ROWS = 48 << 20, 4096
ASKED_BYTES = 64 << 20  # of queries that are broadcast at a time
_BLOCK, _STEP, _BEAM = 4096, 256, 4
_FEW = 1 << 22  # places that meet a condition and are broadcast


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-30))).astype(np.float32)


def _pruned(v: np.ndarray, near: np.ndarray, own: np.ndarray, width: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none) ``width``: such as no nearer one that was taken is
    close to, and then the nearest others. ``own``: the vectors that the rows belong to."""
    like = np.where(near >= 0, np.einsum("bd,bcd->bc", v[own], v[near]), -np.inf)
    order = np.argsort(-like, axis=1, kind="stable")
    near, like = np.take_along_axis(near, order, axis=1), np.take_along_axis(like, order, axis=1)
    away = 2 - 2 * like
    among = 2 - 2 * np.matmul(v[near], v[near].transpose(0, 2, 1))
    taken, dropped = np.zeros(near.shape, dtype=bool), (near < 0) | (near == own[:, None])
    none = dropped.copy()
    for j in range(near.shape[1]):
        taken[:, j] = ~dropped[:, j] & (taken.sum(axis=1) < width)
        dropped |= taken[:, j, None] & (alpha * among[:, j] <= away)
    first = np.argsort(2 * none + ~taken, axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(none, first, axis=1), -1, np.take_along_axis(near, first, axis=1))


def linked(v: np.ndarray, width: int, pool: int, alpha: float, seed: int) -> np.ndarray:
    """The links of each of some unit vectors: a row of ``width`` places, -1 for none."""
    n = len(v)
    if n < 2:
        return np.full((n, width), -1, dtype=np.int32)
    pool = min(pool, n - 1)
    links = np.full((n, width), -1, dtype=np.int64)
    for at in range(0, n, _STEP):
        own = np.arange(at, min(n, at + _STEP))
        like = v[own] @ v.T
        like[own - at, own] = -np.inf
        near = np.argpartition(-like, pool - 1, axis=1)[:, :pool]
        links[own] = np.pad(_pruned(v, near, own, width, alpha), ((0, 0), (0, max(0, width - pool))), constant_values=-1)[:, :width]
    source, target = np.repeat(np.arange(n), width), links.ravel()
    source, target = source[target >= 0], target[target >= 0]
    like = np.einsum("ed,ed->e", v[source], v[target])
    order = np.lexsort((-like, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, width), -1, dtype=np.int64)
    back[target[place < width], place[place < width]] = source[place < width]
    both = np.concatenate([links, back], axis=1)
    for at in range(0, n, _STEP):
        own = np.arange(at, min(n, at + _STEP))
        links[own] = _pruned(v, both[own], own, width, alpha)
    few = min(ANYWHERE, width - 1)
    if few > 0 and n > width:
        links[:, width - few :] = np.random.default_rng(seed).integers(n, size=(n, few))
    return links.astype(np.int32)


def walk(v: np.ndarray, links: np.ndarray, asked: np.ndarray, k: int, ef: int, allowed: np.ndarray | None, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of each query's k best, -1 for none, and how many vectors were looked at."""
    n = len(v)
    wide = ef if allowed is None else min(n, math.ceil(ef * n / max(1, len(allowed))))
    if allowed is not None and (len(allowed) <= 4 * ef or 4 * wide >= n) or 4 * wide >= n:
        some = np.arange(n) if allowed is None else allowed
        scores = np.round(asked @ v[some].T, 6)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return some[best], np.take_along_axis(scores, best, axis=1), scores.size
    good = None if allowed is None else np.isin(np.arange(n), allowed)
    rows, b = np.arange(len(asked))[:, None], len(asked)
    starts = np.random.default_rng(seed).choice(n, min(n, 4 * math.isqrt(n) + 1), replace=False)
    first = asked @ v[starts].T
    seen = np.zeros((b, n), dtype=bool)
    seen[:, starts] = True
    keep = min(wide, len(starts))
    top = np.argsort(-first, axis=1, kind="stable")[:, :keep]
    pool = np.pad(starts[top], ((0, 0), (0, wide - keep)), constant_values=-1)
    value = np.pad(np.take_along_axis(first, top, axis=1), ((0, 0), (0, wide - keep)), constant_values=-np.inf)
    done, looked = pool < 0, first.size
    while True:
        # The best that the walk hasn't gone on from; a pool without any is finished.
        fresh = np.where(done, -np.inf, value)
        pick = np.argsort(-fresh, axis=1, kind="stable")[:, :_BEAM]
        live = np.isfinite(np.take_along_axis(fresh, pick, axis=1))
        if not live.any():
            break
        done[rows, pick] = True
        ahead = np.where(live[:, :, None], links[np.take_along_axis(pool, pick, axis=1)], -1).reshape(b, -1)
        ahead = np.sort(ahead, axis=1)
        new = (ahead >= 0) & ~seen[rows, ahead]
        new[:, 1:] &= ahead[:, 1:] != ahead[:, :-1]
        seen[np.nonzero(new)[0], ahead[new]] = True
        which = np.nonzero(new)[0]
        like = np.full(ahead.shape, -np.inf, dtype=np.float32)
        like[new] = np.einsum("ed,ed->e", asked[which], v[ahead[new]])
        looked += len(which)
        every, names = np.concatenate([value, like], axis=1), np.concatenate([pool, np.where(new, ahead, -1)], axis=1)
        was = np.concatenate([done, ~new], axis=1)
        order = np.argpartition(-every, wide - 1, axis=1)[:, :wide]
        value, pool, done = (np.take_along_axis(x, order, axis=1) for x in (every, names, was))
    if good is not None:
        value = np.where((pool >= 0) & good[pool], value, -np.inf)
    scores = np.round(value.astype(np.float64), 6)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    scores = np.take_along_axis(scores, best, axis=1)
    return np.where(np.isfinite(scores), np.take_along_axis(pool, best, axis=1), -1), scores, looked


class GraphIndex:
    """``shards``: a row per shard; ``rows``: the other columns of every vector, with its
    shard and place, which conditions are asked of. Ids are of any kind and unique; null and
    ragged vectors count as zero."""

    def __init__(self, shards: DataFrame, rows: DataFrame, id_col: str, condition: str | None = None):
        self.shards, self.rows, self.id_col, self.condition = shards, rows, id_col, condition

    @classmethod
    def create(
        cls, vectors: DataFrame, root: str, *, id_col: str = "vec_id", embedding: str = "embedding", links: int = LINKS, pool: int = POOL, alpha: float = ALPHA,
        shard_rows: int | None = None, seed: int = 42,
    ) -> GraphIndex:
        """Writes the index of all rows below ``root``."""
        dim, n, cores = _dim(vectors, embedding), vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
        most = shard_rows or max(1, SHARD_BYTES // (4 * (dim + links)))
        shards = max(1, math.ceil(n / most), min(cores, n // LEAST_ROWS) if shard_rows is None else 1)
        own = vectors.withColumn("_shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
        kind = vectors.schema[id_col].dataType.simpleString()

        def build(key, group):
            v = _unit(matrix(group["v"].combine_chunks()))
            found = linked(v, links, pool, alpha, seed + key[0].as_py())
            ids = group["id"].combine_chunks()
            packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([v.shape[1]], pa.int32()), packed, pa.array([v.tobytes()], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=["shard", "dim", "ids", "vectors", "links"])

        flat = own.select("_shard", F.col(id_col).alias("id"), _sound(embedding, dim).cast("array<float>").alias("v"))
        flat.groupBy("_shard").applyInArrow(build, f"shard int, dim int, ids array<{kind}>, vectors binary, links binary").write.parquet(f"{root}/shards")
        places = vectors.sparkSession.read.parquet(f"{root}/shards").select(F.col("shard").alias("_shard"), F.posexplode("ids").alias("_place", id_col))
        places.join(vectors.drop(embedding), id_col).write.parquet(f"{root}/rows")
        return cls.read(vectors.sparkSession, root, id_col)

    @classmethod
    def read(cls, spark: SparkSession, root: str, id_col: str = "vec_id") -> GraphIndex:
        return cls(spark.read.parquet(f"{root}/shards"), spark.read.parquet(f"{root}/rows"), id_col)

    def where(self, condition: str) -> GraphIndex:
        """The same index, of which searches find only rows that meet the condition."""
        return GraphIndex(self.shards, self.rows, self.id_col, condition if self.condition is None else f"({self.condition}) AND ({condition})")

    def search_many(self, queries: DataFrame, k: int, ef: int = EF) -> DataFrame:
        """(query_id, id, score, rank) for a table of queries (query_id, vector)."""
        if k < 1 or ef < 1:
            raise ValueError("k and ef must be at least 1")
        ef = max(ef, k)
        shards, spark = self.shards, queries.sparkSession
        if self.condition is not None:
            places = settle(self.rows.where(self.condition).groupBy("_shard").agg(F.collect_list("_place").alias("allowed")).withColumnRenamed("_shard", "shard"))
            few = (places.agg(F.sum(F.size("allowed"))).first()[0] or 0) <= _FEW
            shards = shards.join(F.broadcast(places) if few else places, "shard")
        else:
            shards = shards.withColumn("allowed", F.lit(None).cast("array<int>"))
        kind, id_kind = queries.schema["query_id"].dataType.simpleString(), self.rows.schema[self.id_col].dataType.simpleString()
        wide = shards.select("dim").first()
        if wide is None:
            return spark.createDataFrame([], f"query_id {kind}, id {id_kind}, score double, rank int")
        dim = wide["dim"]

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(at, _BLOCK)
                    v, names = _unit(matrix(part.column(1))), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([names, pa.array([v.tobytes()], pa.binary())], names=["names", "asked"])

        blocks = queries.select("query_id", _sound("vector", dim).cast("array<float>").alias("v")).mapInArrow(pack, f"names array<{kind}>, asked binary")
        # Numbered once, as written.
        blocks = settle(blocks.withColumn("block", F.monotonically_increasing_id()))
        sizes = blocks.select("block", F.length("asked").alias("size")).collect()  # a row for each 4096 queries

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    at = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                    ids, names = at["ids"].values, at["names"].values
                    v = np.frombuffer(at["vectors"].as_buffer(), dtype=np.float32).reshape(len(ids), -1)
                    links = np.frombuffer(at["links"].as_buffer(), dtype=np.int32).reshape(len(ids), -1)
                    asked = np.frombuffer(at["asked"].as_buffer(), dtype=np.float32).reshape(len(names), -1)
                    allowed = None if not at["allowed"].is_valid else np.sort(at["allowed"].values.to_numpy())
                    for first in range(0, len(names), _STEP):
                        places, scores, _ = walk(v, links, asked[first : first + _STEP], k, ef, allowed, at["shard"].as_py())
                        q, c = np.nonzero(places >= 0)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(first + q)), ids.take(pa.array(places[q, c])), pa.array(scores[q, c].astype(np.float64) + 0.0)], names=["query_id", "id", "score"])

        found, group, room = None, [], ASKED_BYTES
        for i, r in enumerate(sizes):
            group.append(r["block"])
            room -= r["size"]
            if room > 0 and i + 1 < len(sizes):
                continue
            # As many blocks as take that many bytes meet every shard where it lies.
            some = F.broadcast(blocks.where(F.col("block").isin(group)))
            pairs = shards.withColumn("block", F.explode(F.lit(group))).join(some, "block").select("shard", "ids", "vectors", "links", "allowed", "names", "asked")
            part = pairs.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")
            found, group, room = part if found is None else found.unionByName(part), [], ASKED_BYTES
        if found is None:
            return spark.createDataFrame([], f"query_id {kind}, id {id_kind}, score double, rank int")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, query, k: int, ef: int | None = None) -> DataFrame:
        """(id, score, rank) of one query."""
        one = self.shards.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<double>")
        return self.search_many(one, k, ef or EF).select("id", "score", F.col("rank").cast("long").alias("rank"))
