"""The graph of each vector's nearest neighbours, by NN-descent (Dong, Moses and Li, 2011).

It starts from random projection trees: in each tree all vectors of a leaf are compared.
Rounds of descent then compare the neighbours of each vector, and those it is a neighbour
of, with each other, and keep what is nearer than what they had. Every step is a shuffle of
rows; a task holds one leaf, or one vector's few neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.operators.dense import _dim, _sound
from siftlight.sources.tables import dealt, settle

K, TREES, LEAF, ROUNDS, SEED = 15, 8, 256, 4, 42
JOINED = 5  # cuts of a tree that are left out at the start: 32 leaves are compared at once
SLICE, LOT = 1024, 16  # of a leaf's vectors are compared with all of it at a time; scores of which the best is looked at first
SETTLED = 0.001  # of all neighbours: with fewer new ones in a round, the descent is over, as in the paper
SAMPLED = 4096  # vectors whose projections tell where trees are cut


def matrix(lists: pa.Array) -> np.ndarray:
    """A row for each list; all have the same length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0), dtype=np.float32)


def planted(vectors: DataFrame, *, id_col: str, embedding: str, trees: int, leaf: int, seed: int) -> DataFrame:
    """(id, v, codes): vectors at length one, and the leaf of each in every tree. A tree cuts
    the vectors in halves along random directions, at the medians of a sample."""
    rows = vectors.select(F.col(id_col).alias("id"), _sound(embedding, dim := _dim(vectors, embedding)).cast("array<float>").alias("v"))
    n = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    axes = np.random.default_rng(seed).standard_normal((trees * bits, dim)).astype(np.float32)
    share = min(1.0, SAMPLED / max(1, n))
    hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    seen = rows.where(hashed < math.ceil(share * (1 << 20))).limit(2 * SAMPLED).select("v").toArrow()["v"].combine_chunks()

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-30))

    cuts = np.median(unit(matrix(seen)) @ axes.T, axis=0) if bits and len(seen) else np.zeros(trees * bits)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            v = unit(matrix(batch.column(1)))
            sides = (v @ axes.T > cuts).reshape(len(v), trees, bits) if len(v) else np.zeros((0, trees, bits))
            codes = (sides * powers).sum(axis=2, dtype=np.int64) if bits else np.zeros((len(v), trees), dtype=np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (v, codes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "v", "codes"])

    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.mapInArrow(run, f"id {kind}, v array<float>, codes array<long>"))


def _runs(batches, key: int):
    """(table, ends) of whole groups: rows that agree in the column ``key`` are next to each
    other, and groups end at ``ends``. What may go on in the next batch waits for it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        cuts = 1 + np.flatnonzero(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False))
        before = sum(x.num_rows for x in held)
        if before and held[-1].column(key)[held[-1].num_rows - 1] != values[0]:
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]), before + cuts
            held = []
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
    if held:
        yield (table := pa.Table.from_batches(held)), np.array([table.num_rows])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of (id, neighbour, score, fresh); what was there before isn't fresh."""
    once = found.repartition("id").groupBy("id", "neighbour").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    # Ties in an order of each row's own, else copies would all name the same few.
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.xxhash64("id", "neighbour"), "neighbour")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def highest(scores: np.ndarray, m: int) -> np.ndarray:
    """The columns of the ``m`` highest scores of each row: they are in the ``m`` lots of
    columns whose best scores are highest."""
    rows, n = scores.shape
    lots = n // LOT
    if lots <= 2 * m:
        return np.argpartition(-scores, m - 1, axis=1)[:, :m]
    tops = scores[:, : lots * LOT].reshape(rows, LOT, lots).max(axis=1)
    lot = np.argpartition(-tops, m - 1, axis=1)[:, :m]
    columns = (lot[:, :, None] + lots * np.arange(LOT)).reshape(rows, -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(lots * LOT, n), (rows, n - lots * LOT))], axis=1)
    best = np.argpartition(-np.take_along_axis(scores, columns, axis=1), m - 1, axis=1)[:, :m]
    return np.take_along_axis(columns, best, axis=1)


def _first(table: DataFrame, k: int, leaf: int, kind: str) -> DataFrame:
    """The k nearest in each vector's leaves, several leaves together: products of matrices
    are cheap, and each neighbour that is found here is one that no round has to shuffle."""
    leaves = table.select("id", "v", F.posexplode("codes").alias("tree", "code")).withColumn("code", F.shiftright("code", JOINED))
    leaves = dealt(leaves, ["tree", "code"], leaf << JOINED)

    def run(group: pa.Table) -> pa.Table:
        ids, v = group["id"].combine_chunks(), matrix(group["v"].combine_chunks())
        m = min(k, len(v) - 1)
        # Ties in an order of each row's own, else copies would all name the same few.
        rng = np.random.default_rng(len(v))
        ties = rng.random(2 * len(v), dtype=np.float32) * np.float32(1e-6)
        near, values = np.empty((len(v), m), dtype=np.int64), np.empty((len(v), m))
        for at in range(0, len(v) if m > 0 else 0, SLICE):
            scores = v[at : at + SLICE] @ v.T
            own = np.arange(len(scores))[:, None]
            for row, turn in zip(scores, rng.integers(len(v), size=len(scores)).tolist()):
                row += ties[turn : turn + len(v)]
            scores[own, own + at] = -np.inf
            near[at : at + SLICE] = best = highest(scores, m)
            values[at : at + SLICE] = np.einsum("ijc,ic->ij", v[best], v[at : at + SLICE])
        own = np.repeat(np.arange(len(v)), m)
        return pa.table([ids.take(pa.array(own)), ids.take(pa.array(near.ravel())), pa.array(np.round(values.ravel(), 6)), pa.array(np.ones(len(own), dtype=bool))], names=["id", "neighbour", "score", "fresh"])

    return leaves.groupBy("tree", "code", "part").applyInArrow(run, f"id {kind}, neighbour {kind}, score double, fresh boolean")


def _round(graph: DataFrame, table: DataFrame, k: int, kind: str, salt: int) -> DataFrame:
    """What the neighbours of each vector have nearer to them among themselves."""
    least = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
    ahead = graph.select(F.col("id").alias("a"), F.col("neighbour").alias("id"), "fresh")
    back = graph.select(F.col("neighbour").alias("a"), "id", "fresh")
    some = Window.partitionBy("a").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(salt)), "id")
    back = back.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k).drop("r")
    members = ahead.unionByName(back).join(table.select("id", "v").join(least, "id", "left"), "id")
    members = members.select("a", "id", "fresh", F.coalesce("least", F.lit(-2.0)).alias("least"), "v")

    def run(batches):
        for groups, ends in _runs(batches, 0):
            ids, v = groups["id"].combine_chunks(), matrix(groups["v"].combine_chunks())
            fresh, least = groups["fresh"].to_numpy(), groups["least"].to_numpy()
            codes = ids.dictionary_encode().indices.to_numpy()
            out, held, at = [], 0, 0
            for end in ends.tolist():
                if (new := fresh[at:end]).any():
                    part, code = v[at:end], codes[at:end]
                    scores = np.round((part @ part.T).astype(np.float64), 6)
                    i, j = np.nonzero((scores > least[at:end, None]) & (new[:, None] | new) & (code[:, None] != code))
                    out.append((at + i, at + j, scores[i, j]))
                    held += len(i)
                at = end
                if held > 65_536 or out and at == len(v):
                    i, j, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(scores), pa.array(np.ones(len(i), dtype=bool))], names=["id", "neighbour", "score", "fresh"])
                    out, held = [], 0

    met = members.repartition("a").sortWithinPartitions("a").mapInArrow(run, f"id {kind}, neighbour {kind}, score double, fresh boolean")
    return met.unionByName(graph.select("id", "neighbour", "score", F.lit(False).alias("fresh")))


def grown(table: DataFrame, k: int = K, *, pool: int | None = None, leaf: int = LEAF, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, neighbour, score, rank) over ``planted`` vectors; the descent goes over the
    ``pool`` nearest, by default three times k, of which the k best stay."""
    kind, wide = table.schema["id"].dataType.simpleString(), max(k, pool or 3 * k)
    trees = F.size(F.first("codes"))
    trees, n = table.agg(trees.alias("trees"), F.count("*").alias("n")).first()
    # All that are nearest in a tree, and twice the pool from all trees.
    graph = settle(_best(_first(table, max(k, -(-2 * wide // max(1, trees or 1))), leaf, kind), wide))
    for r in range(rounds):
        graph = settle(_best(_round(graph, table, wide, kind, seed + r), wide))
        if graph.where(F.col("fresh") & (F.col("rank") <= k)).count() <= SETTLED * k * n:
            break
    return graph.where(F.col("rank") <= k).select("id", "neighbour", "score", F.col("rank").cast("long").alias("rank"))


def graph(
    vectors: DataFrame, k: int = K, *, id_col: str = "vec_id", embedding: str = "embedding", pool: int | None = None, trees: int = TREES, leaf: int = LEAF,
    rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """(id, neighbour, score, rank): about the k nearest other rows of each, by cosine. Ids
    are of any kind and unique; null and ragged vectors count as zero. Vectors that spread
    in many directions need a wider ``pool`` than such as lie near a surface."""
    if min(k, trees, leaf) < 1:
        raise ValueError("k, trees and leaf must be at least 1")
    return grown(planted(vectors, id_col=id_col, embedding=embedding, trees=trees, leaf=leaf, seed=seed), k, pool=pool, leaf=leaf, rounds=rounds, seed=seed)
