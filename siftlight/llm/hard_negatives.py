"""Hard negatives: for an anchor and a positive, rows of another label that score nearly as high.

Scores are integer inner products of vectors in fixed point. Anchors are dealt into groups
and all rows into parts, by counts, so that a task holds one group and one part. It scores
and sorts them in full for each anchor, by score and then id; a binary search finds where a
positive's upper limit stands, and the first ``k`` rows of another label from there on that
reach the lower limit are read. What the parts have read meets per anchor and positive,
``k`` rows from each part at most. The positives, the best rows of an anchor's own label,
are found the same way before.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; a null condition makes no anchor; shorter vectors count as if they
ended in zeros; a score beyond 64 bits counts as the largest or least of them; a row of an
anchor's id isn't its positive. Of an id that occurs more than once each row is ranked, and
each is an anchor of its own, so that results repeat. Equal scores are in the order of ids.
Other columns are ignored; an anchor without positives, or a positive without negatives,
gives no row; empty in, empty out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.llm.common import settle

#: Anchors and rows of one task, at most (but for how evenly hashes deal them).
ANCHORS, ROWS = 1 << 14, 1 << 17
_CELLS = 1 << 22  # scores sorted at a time
_MOST = int(np.iinfo(np.int64).max)


def _fixed(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """A row of integers for each vector: int64, or Python's where they don't fit."""
    vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    flat = np.floor(scale * values)
    if not np.abs(flat).max(initial=0.0) < 2.0**62:
        flat = np.array([int(x) if math.isfinite(x) else int(v) * int(scale) for x, v in zip(flat, values)], dtype=object)
    else:
        flat = flat.astype(np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)), dtype=flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exactly."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = dim * int(abs(a).max(initial=0)) * int(abs(b).max(initial=0))
    if most < 1 << 53:  # no sum is rounded
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most <= _MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _ranked(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of scores, the columns from the best to the last."""
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=-1)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


def _steps(n: int, rows: int):
    step = max(1, _CELLS // max(1, rows))
    return ((at, min(n, at + step)) for at in range(0, n, step))


def _pairs(anchors: DataFrame, rows: DataFrame, groups: int, parts: int, run, schema: str) -> DataFrame:
    """``run`` over each group of anchors with each part of the rows."""
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")
    left = anchors.withColumn("group", group).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # The part of a row follows from all of it, so that it is the same when a task runs again.
    part = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(parts)).cast("int")
    right = rows.withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ("group", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256,
    positives: int = 5, k: int = 5, low: int = 80, high: int = 100, group_rows: int = ANCHORS, part_rows: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    of the ``positives`` best rows of an anchor's label the ``k`` best rows of another label
    with ``low * positive <= 100 * negative <= high * positive``. ``anchors``: a condition on
    the columns of ``vectors``; any number of rows may meet it."""
    if min(positives, k, group_rows, part_rows) < 1:
        raise ValueError("counts must be at least 1")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    sound &= ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = F.coalesce(anchors, F.lit(False)).alias("asked")
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), asked)
    # A key for each anchor, which stays: the rows are written before they are read again.
    own = settle(rows.where("asked").select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), F.col("label").alias("own"), F.col("vector").alias("at")))
    rows = rows.drop("asked")
    count, n = rows.count(), own.count()
    least = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    groups, parts = max(1, math.ceil(n / group_rows)), max(least, math.ceil(count / part_rows))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        (anchor, self_id, own), (ids, labels) = _columns(left, "anchor", "anchor_id", "own"), _columns(right, "id", "label")
        a, b, found = _fixed(left["at"], scale), _fixed(right["vector"], scale), []
        for label in np.intersect1d(own, labels):
            asking, there = np.flatnonzero(own == label), np.flatnonzero(labels == label)
            for first, last in _steps(len(asking), len(there)):
                some = asking[first:last]
                scores = _scores(a[some], b[there])
                order = _ranked(scores, ids[there])
                for i, row, best in zip(some, scores, order):
                    best = best[: positives + int((ids[there] == self_id[i]).sum())]
                    best = best[ids[there[best]] != self_id[i]][:positives]
                    found.append((np.full(len(best), anchor[i]), np.full(len(best), self_id[i]), ids[there[best]], row[best]))
        return pa.table([np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else [()] * 4)], names=["anchor", "anchor_id", "id", "score"])

    best = _first(_pairs(own, rows, groups, parts, near, "anchor long, anchor_id long, id long, score long"), ["anchor"], positives)
    limits = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("limits"))
    bound = settle(own.join(limits, "anchor").select("anchor", "anchor_id", "own", "at", F.col("limits.rank").alias("ranks"), F.col("limits.id").alias("positive_ids"), F.col("limits.score").alias("scores")))

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        (anchor, self_id, own), (ids, labels) = _columns(left, "anchor", "anchor_id", "own"), _columns(right, "id", "label")
        asked = [left[c].to_pylist() for c in ("ranks", "positive_ids", "scores")]
        a, b, found = _fixed(left["at"], scale), _fixed(right["vector"], scale), []
        for first, last in _steps(len(anchor), len(ids)):
            scores = _scores(a[first:last], b)
            for i, row, order in zip(range(first, last), scores, _ranked(scores, ids)):
                falling = row[order]
                other = np.flatnonzero(labels[order] != own[i])
                for rank, positive, score in zip(*(x[i] for x in asked)):
                    # Bounds in Python's integers, which don't overflow.
                    upper, lower = high * score // 100, -(-low * score // 100)
                    start = len(falling) - np.searchsorted(falling[::-1], min(max(upper, -_MOST), _MOST), side="right")
                    taken = order[other[np.searchsorted(other, start) :][:k]]
                    found += [(anchor[i], self_id[i], rank, positive, score, ids[j], row[j]) for j in taken if lower <= int(row[j]) <= upper]
        names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "id", "score"]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*found) if found else [()] * 7)], names=names)

    schema = "anchor long, anchor_id long, place long, positive_id long, positive_score long, id long, score long"
    mined = _first(_pairs(bound, rows, groups, parts, hard, schema), ["anchor", "place"], k)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
