"""k-means over embeddings, the choice of k, and reports on clusters."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions.text import preview
from siftlight.sources.tables import spread

K, INITS, SWEEP_INITS, SEED, ITERATIONS = 10, 10, 3, 42, 300
SAMPLE, WEAK = 8_000, 0.10
PARALLEL = 4  # first centres, and measurements, at a time
TOLERANCE = 1e-4  # MLlib's
#: Vectors in a row of packed ones; bytes of sums that a round may bring to the driver.
_PACKED, _ROOM = 1024, 64 << 20


def _features(vectors: DataFrame, embedding: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))


@dataclass
class _Fit:
    """A start of k-means: its centres so far, and the sum of squared distances to those before."""

    centres: np.ndarray
    cost: float = math.inf


def _fit(table: DataFrame, starts: list[tuple[int, int]], iterations: int, embedding: str) -> list[_Fit]:
    """k-means for each (k, seed). MLlib picks the first centres (k-means||); then all fits
    go on together, a scan of the vectors a round for all that haven't converged, so that
    there are as many scans as the longest fit has rounds. A fit ends as MLlib's does: when
    no centre moves by more than its tolerance."""
    from pyspark.ml.clustering import KMeans

    def first(start: tuple[int, int]) -> _Fit:
        model = KMeans(k=start[0], seed=start[1], maxIter=0, featuresCol="_v", predictionCol="cluster").fit(table)
        return _Fit(np.array(model.clusterCenters()))

    fits = _together(first, starts)
    packed = _packed(table, embedding).persist()
    try:
        going, tasks = fits, packed.rdd.getNumPartitions()
        for _ in range(iterations):
            if not going:
                break
            moved = []
            for fit, (sums, counts, cost) in zip(going, _scanned(packed, [f.centres for f in going], tasks)):
                # A centre without vectors stays.
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fit.centres)
                if (((new - fit.centres) ** 2).sum(axis=1) > TOLERANCE**2).any():
                    moved.append(fit)
                fit.centres, fit.cost = new, cost
            going = moved
    finally:
        packed.unpersist()
    return fits


def _packed(table: DataFrame, embedding: str) -> DataFrame:
    """(v): the vectors, as bytes of doubles, some thousand in a row, on all cores."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _PACKED):
                v = batch.column(0).slice(at, _PACKED).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

    rows = table.select(F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, "v binary")
    cores = table.sparkSession.sparkContext.defaultParallelism
    # Each task sums for itself: no more tasks than twice the cores.
    return spread(rows).coalesce(2 * cores)


def _scanned(packed: DataFrame, centres: list[np.ndarray], tasks: int, room: int = _ROOM) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit: the sums and counts of the vectors nearest to each of its centres, and
    the sum of their squared distances. Where the sums of all ``tasks`` take over ``room``
    bytes, executors add them up first."""
    every, dim = np.concatenate(centres), centres[0].shape[1]
    cuts = np.cumsum([0, *map(len, centres)]).tolist()
    ranges = list(zip(cuts, cuts[1:]))

    def run(batches):
        size = (every**2).sum(axis=1)[:, None]
        # For each centre the sum of its vectors, their count and their cost.
        total = np.zeros((len(every), dim + 2))
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, dim)
                away = size - 2 * (every @ v.T)
                own, one, lengths = np.zeros(away.shape), np.arange(len(v)), (v**2).sum(axis=1)
                for a, b in ranges:
                    near = a + away[a:b].argmin(axis=0)
                    own[near, one] = 1
                    total[a, dim + 1] += np.maximum(away[near, one] + lengths, 0).sum()
                total[:, :dim] += own @ v
                total[:, dim] += own.sum(axis=1)
        for i, (a, b) in enumerate(ranges):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[a:b].tobytes()], pa.binary())], names=["fit", "sums"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + np.frombuffer(x.as_buffer(), dtype=np.float64)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], names=["fit", "sums"])

    parts = packed.mapInArrow(run, "fit long, sums binary")
    if tasks * every.nbytes > room:
        parts = parts.repartition("fit").mapInArrow(added, "fit long, sums binary")
    found = [np.zeros((b - a, dim + 2)) for a, b in ranges]
    for batch in parts.toArrow().to_batches():
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[i] += np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, dim + 2)
    return [(x[:, :dim], x[:, dim], float(x[0, dim + 1])) for x in found]


def _labels(centres: list[np.ndarray]):
    """A function of a column of vectors: for each of some fits the number of the nearest centre."""

    @F.arrow_udf("array<int>")
    def near(vectors: pa.Array) -> pa.Array:
        v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        found = np.stack([((c**2).sum(axis=1) - 2 * (v @ c.T)).argmin(axis=1) for c in centres], axis=1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(centres), dtype=np.int32)), pa.array(found.ravel()))

    return near


def _together(action, items) -> list:
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(action, items))


def kmeans(vectors: DataFrame, k: int = K, *, inits: int = INITS, seed: int = SEED, iterations: int = ITERATIONS, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``cluster``, in place of any they have: the best of several starts, by
    the sum of squared distances, the first of equal ones. Raises ValueError if there are
    fewer than k rows."""
    vectors = vectors.drop("cluster")
    table = _features(vectors, embedding).select(embedding, "_v").persist()
    try:
        if not 1 <= k <= table.count():
            raise ValueError(f"k={k} needs from 1 to as many clusters as vectors")
        best = min(_fit(table, [(k, seed + i) for i in range(inits)], iterations, embedding), key=lambda f: f.cost)
    finally:
        table.unpersist()
    return vectors.withColumn("cluster", _labels([best.centres])(F.col(embedding).cast("array<double>"))[0])


def sizes(labelled: DataFrame, k: int, label: str = "cluster") -> DataFrame:
    """(cluster, n) for all of 0 to k - 1, empty ones too."""
    every = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    counts = labelled.groupBy(F.col(label).cast("int").alias("cluster")).agg(F.count("*").alias("n"))
    return every.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def members(labelled: DataFrame, k: int, first: int = 10, label: str = "cluster", id_col: str = "id", text_col: str | None = None) -> DataFrame:
    """(cluster, n, first_ids): the sizes and the first members, each cluster's few
    smallest ids being kept before anything is gathered."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    columns = [F.col(label).cast("int").alias("cluster"), F.col(id_col).alias("id")]
    if text_col:
        columns.append(preview(F.col(text_col)).alias("text"))
    ranked = labelled.select(*columns).withColumn("rank", rank).where(F.col("rank") <= first)
    shown = F.array_sort(F.collect_list(F.struct("id", "text") if text_col else F.col("id")))
    return sizes(labelled, k, label).join(ranked.groupBy("cluster").agg(shown.alias("first_members")), "cluster", "left")


def silhouette(labelled: DataFrame, embedding: str = "embedding", label: str = "cluster") -> float:
    """Mean silhouette by cosine distance over all rows; NaN with fewer than two labels."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    table = _features(labelled.where(F.col(label).isNotNull()), embedding).withColumn("_p", F.col(label).cast("double"))
    if table.select("_p").distinct().limit(2).count() < 2:
        return math.nan
    return ClusteringEvaluator(featuresCol="_v", predictionCol="_p", distanceMeasure="cosine").evaluate(table)


def subsample(rows: DataFrame, n: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """n rows without replacement, by order of a hash of their ids; all if n isn't
    positive or there aren't more."""
    return rows if n <= 0 else rows.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


@dataclass(frozen=True)
class Scored:
    k: int
    silhouette: float
    inertia: float
    smallest: int


def _scores(table: DataFrame, fits: dict[int, _Fit], embedding: str) -> list[Scored]:
    """Measures a fit of each k; all rows are measured, and led to the centres of all fits at once."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    placed = table.select("_v", _labels([f.centres for f in fits.values()])(F.col(embedding).cast("array<double>")).alias("_near")).persist()
    try:
        # A row per cluster of each k.
        held = placed.select(F.posexplode("_near").alias("fit", "cluster")).groupBy("fit", "cluster").count().collect()

        def score(at: tuple[int, int]) -> Scored:
            i, k = at
            counts = [r["count"] for r in held if r["fit"] == i]
            value = math.nan
            if len(counts) >= 2:
                rows = placed.select("_v", F.col("_near")[i].alias("cluster"))
                value = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine").evaluate(rows)
            return Scored(k, value, fits[k].cost, min(counts) if len(counts) == k else 0)

        return _together(score, enumerate(fits))
    finally:
        placed.unpersist()


def sweep(
    vectors: DataFrame, min_k: int = 2, max_k: int = 20, step: int = 1, *, sample: int = SAMPLE, id_col: str = "id",
    embedding: str = "embedding", inits: int = SWEEP_INITS, seed: int = SEED,
) -> DataFrame:
    """(k, silhouette, inertia, smallest) for each k, on at most ``sample`` vectors (0: all)."""
    if min_k < 2 or max_k < min_k:
        raise ValueError("k goes from 2 or more to no less than that")
    table = _features(subsample(vectors, sample, id_col, seed), embedding).select(embedding, "_v").persist()
    try:
        if max_k >= table.count():
            raise ValueError("max_k must be below the number of vectors")
        starts = [(k, seed + i) for k in range(min_k, max_k + 1, step) for i in range(inits)]
        best: dict[int, _Fit] = {}
        for (k, _), fit in zip(starts, _fit(table, starts, ITERATIONS, embedding)):
            if k not in best or fit.cost < best[k].cost:
                best[k] = fit
        rows = _scores(table, best, embedding)
    finally:
        table.unpersist()
    return vectors.sparkSession.createDataFrame([(r.k, r.silhouette, r.inertia, r.smallest) for r in rows], "k int, silhouette double, inertia double, smallest int")


def best_k(swept: DataFrame) -> Scored | None:
    """The row of the largest silhouette, the smallest such k; None if none was scored."""
    row = swept.where(~F.isnan("silhouette")).orderBy(F.desc("silhouette"), "k").first()
    return None if row is None else Scored(row["k"], row["silhouette"], row["inertia"], row["smallest"])


def report(swept: DataFrame) -> str:
    """What the sweep says about k, in words."""
    best = best_k(swept)
    if best is None:
        raise ValueError("no k could be scored: are there enough vectors?")
    lines = [f"Best by silhouette: k={best.k} ({best.silhouette:.4f}; smallest cluster: {best.smallest})."]
    if best.silhouette < WEAK:
        lines.append(f"Below {WEAK} the clusters hardly part; a density-based method may describe these vectors better.")
    lines.append("An elbow in the inertia is a second sign: the k from which it falls slowly.")
    return "\n".join(lines)


def attach_labels(entries: DataFrame, labelled: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """``entries`` with the cluster of their text: of equal texts the label of the largest
    id; null where a text has none."""
    by_text = labelled.groupBy(F.col(text).alias("_text")).agg(F.max_by("cluster", id_col).alias("cluster"))
    return entries.join(by_text, F.col(text) == F.col("_text"), "left").drop("_text")


def write_labelled(entries: DataFrame, labelled: DataFrame, path: str, text: str = "text", id_col: str = "id") -> tuple[int, int]:
    """Writes ``entries`` with their clusters as JSON lines; how many there are, and how
    many of them have no label."""
    attach_labels(entries, labelled, text, id_col).write.mode("overwrite").json(path)
    missed = F.count_if(F.col("cluster").isNull()) if entries.take(1) else F.lit(0)
    written = entries.sparkSession.read.schema("cluster int").json(path).agg(F.count("*").alias("n"), missed.alias("missed")).first()
    return written["n"], written["missed"]


def fit_pca(spark: SparkSession, vectors: DataFrame, embedding: str = "embedding"):
    from pyspark.ml.feature import PCA

    return PCA(k=2, inputCol="_v", outputCol="_xy").fit(_features(vectors, embedding))
