"""Two-dimensional layouts of vectors by UMAP or PCA, and their plot."""

from __future__ import annotations

import html
import io
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.operators.cluster import _features, fit_pca
from siftlight.operators.neighbours import LEAF, TREES, grown, planted
from siftlight.sources.tables import dealt, settle

MANY = 5_000  # points that are drawn smaller
NEIGHBOURS, MIN_DIST, SEED = 15, 0.1, 42
ROUNDS, STEPS, BLOCK, FAR, REPELLED = 8, 25, 4096, 8192, 5


def pca(vectors: DataFrame, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, x, y) on the two main components, for any number of vectors."""
    from pyspark.ml.functions import vector_to_array

    model = fit_pca(vectors.sparkSession, vectors, embedding)
    xy = vector_to_array(F.col("_xy"))
    return model.transform(_features(vectors, embedding)).select(F.col(id_col).alias("id"), xy[0].alias("x"), xy[1].alias("y"))


def _memberships(distances: np.ndarray) -> np.ndarray:
    """Fuzzy memberships of each point's neighbours: exp(-(d - rho) / sigma), sigma such
    that a row sums to log2 of the number of neighbours. Where a row has fewer, it is infinite."""
    goal = np.log2(np.maximum(2, np.isfinite(distances).sum(axis=1)))
    apart = distances - distances.min(axis=1, keepdims=True)
    low, high = np.full(len(distances), 1e-9), np.full(len(distances), 1e3)
    for _ in range(60):
        middle = (low + high) / 2
        total = np.exp(-apart / middle[:, None]).sum(axis=1)
        high, low = np.where(total > goal, middle, high), np.where(total > goal, low, middle)
    return np.exp(-apart / high[:, None])


def fuzzy_union(near: DataFrame) -> DataFrame:
    """(id, other, weight) in both directions, of (id, neighbour, score, rank): the fuzzy
    union w + v - w * v of what two vectors hold of each other."""
    kind = near.schema["id"].dataType.simpleString()
    rows = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "score"))).alias("n")).select("id", F.col("n.neighbour").alias("others"), F.col("n.score").alias("scores"))

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat = batch.column(2).flatten().to_numpy()
            away, real = np.full((len(sizes), sizes.max(initial=1)), np.inf), np.arange(sizes.max(initial=1)) < sizes[:, None]
            away[real] = np.maximum(1 - flat, 0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, batch.column(1).flatten(), pa.array(_memberships(away)[real])], names=["id", "other", "weight"])

    held = rows.mapInArrow(run, f"id {kind}, other {kind}, weight double")
    both = held.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.sum("weight").alias("s"), F.when(F.count("*") > 1, F.max("weight") * F.min("weight")).otherwise(0.0).alias("p"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return both.select(ends.alias("e"), (F.col("s") - F.col("p")).alias("weight")).select("e.id", "e.other", "weight")


def _curve(min_dist: float) -> tuple[float, float]:
    """The curve 1 / (1 + a d^(2b)) for this least distance, by the usual fit on [0, 3]."""
    d = np.linspace(1e-3, 3, 300)
    target = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist)))
    grid = [(((1 / (1 + a * d ** (2 * b)) - target) ** 2).sum(), a, b) for a in np.linspace(0.3, 3, 55) for b in np.linspace(0.5, 1.5, 41)]
    return min(grid)[1:]


def _start(table: DataFrame, seed: int) -> DataFrame:
    """(id, x, y): the two main components, at most ten from the middle; copies a little apart."""
    dim = len((table.select("v").first() or [[]])["v"])
    flat = pca(table, "id", "v") if dim > 1 else table.select("id", F.coalesce(F.col("v")[0], F.lit(0.0)).cast("double").alias("x"), F.lit(0.0).alias("y"))
    size = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    shift = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(10_000)) / 10_000 - 0.5) * 0.01
    return flat.select("id", (F.col("x") * (10 / size) + shift(0)).alias("x"), (F.col("y") * (10 / size) + shift(1)).alias("y"))


def _moved(edges: pa.Table, at: pa.Table, far: np.ndarray, rates: np.ndarray, curve: tuple[float, float], seed: int) -> pa.Table:
    """The own points of a block after a step for each rate: pulled along edges, pushed by
    some of ``far``. What the edges lead to in other blocks stands still meanwhile."""
    a, b = curve
    ids, own = at["id"].combine_chunks(), at["own"].to_numpy()
    y = np.stack([at["x"].to_numpy(), at["y"].to_numpy()], axis=1)
    head, tail = (pc.index_in(edges[c].combine_chunks(), value_set=ids).to_numpy() for c in ("id", "other"))
    weight, rng = edges["weight"].to_numpy(), np.random.default_rng(seed)
    for rate in rates:
        live = rng.random(len(weight)) < weight
        i, j = head[live], tail[live]
        gap = y[i] - y[j]
        d2 = (gap**2).sum(axis=1, keepdims=True) + 1e-9
        move = np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * gap, -4, 4)
        for _ in range(REPELLED):
            gap = y[i] - far[rng.integers(len(far), size=len(i))]
            d2 = (gap**2).sum(axis=1, keepdims=True)
            move += np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * gap, -4, 4)
        total = np.stack([np.bincount(i, move[:, c], minlength=len(y)) for c in (0, 1)], axis=1)
        y += rate * np.clip(total, -4, 4)
    mine = pa.array(own)
    return pa.table([ids.filter(mine), pa.array(y[own, 0]), pa.array(y[own, 1])], names=["id", "x", "y"])


def _mover(far, rates: np.ndarray, curve: tuple[float, float], seed: tuple[int, int]):
    def run(key, mine: pa.Table, at: pa.Table) -> pa.Table:
        return _moved(mine, at, far.value, rates, curve, hash((*seed, key[0].as_py(), key[1].as_py())) & 0xFFFFFFFF)

    return run


def umap(
    vectors: DataFrame, id_col: str = "id", embedding: str = "embedding", *, neighbours: int = NEIGHBOURS, min_dist: float = MIN_DIST, rounds: int = ROUNDS,
    steps: int = STEPS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(id, x, y) by UMAP (McInnes, Healy and Melville, 2018), by cosine: a graph of nearest
    neighbours, their fuzzy union, a start from the main components, then attraction along
    edges and sampled repulsion.

    Vectors that lie together are a block of about ``block``. In a round each block moves its
    own points for some steps, against the places that others had when the round began and a
    sample of ``FAR`` of all points; then all learn the new places. Ids are unique."""
    spark = vectors.sparkSession
    table = planted(vectors, id_col=id_col, embedding=embedding, trees=TREES, leaf=LEAF, seed=seed)
    kind, n = table.schema["id"].dataType.simpleString(), table.count()
    if n < 3:
        return table.select("id", F.row_number().over(Window.orderBy("id")).cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = settle(fuzzy_union(grown(table, min(neighbours, n - 1), leaf=LEAF, seed=seed)))
    block = min(block, max(LEAF, n // (2 * spark.sparkContext.defaultParallelism)))
    cells = 1 << max(0, math.ceil(math.log2(n / block)))
    # The first cuts of a tree give a block; one with far more vectors is cut in parts.
    owned = settle(dealt(table.select("id", F.pmod(F.col("codes")[0], F.lit(cells)).alias("cell")), ["cell"], block))
    inside = settle(edges.join(owned, "id"))
    there = inside.select(F.col("other").alias("id"), "cell", "part", F.lit(False).alias("own")).unionByName(owned.withColumn("own", F.lit(True)))
    there = there.groupBy("id", F.col("cell").alias("to_cell"), F.col("part").alias("to_part"))
    there = settle(there.agg(F.max("own").alias("own")))
    places, curve = settle(_start(table, seed)), _curve(min_dist)
    for r in range(rounds):
        share = min(1 << 20, math.ceil(FAR / n * (1 << 20)))
        seen = places.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1 << 20)) < share).limit(2 * FAR).select("x", "y").toArrow()
        far = spark.sparkContext.broadcast(np.stack([seen["x"].to_numpy(), seen["y"].to_numpy()], axis=1) if len(seen) else np.zeros((1, 2)))
        rates = 1 - (r * steps + np.arange(steps)) / (rounds * steps)

        at = there.join(places, "id").groupBy("to_cell", "to_part")
        places = settle(inside.groupBy("cell", "part").cogroup(at).applyInArrow(_mover(far, rates, curve, (seed, r)), f"id {kind}, x double, y double"))
        far.destroy()
    return places


def plot_to(points: DataFrame, out, title: str = "Clusters") -> int:
    """Writes a page with a scatter of (x, y, cluster, text) to ``out``: a colour for each
    cluster, the text as the tooltip. Rows without a cluster are in a group of their own.
    All points are there; they pass through the driver one partition at a time."""
    box = points.agg(F.count("*").alias("n"), *(f(c).alias(f.__name__ + c) for f in (F.min, F.max) for c in "xy")).first()
    if not box["n"]:
        raise ValueError("there is nothing to plot")
    span_x, span_y = (box["maxx"] - box["minx"]) or 1, (box["maxy"] - box["miny"]) or 1
    labels = sorted((r["cluster"] for r in points.select("cluster").distinct().collect()), key=lambda c: (c is None, c if c is not None else 0))
    colours = {label: f"hsl({n * 360 // len(labels)},65%,50%)" for n, label in enumerate(labels)}
    radius, style = (1.5, 'fill-opacity="0.5"') if box["n"] > MANY else (5, 'stroke="white" stroke-width="0.5"')
    out.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><svg viewBox='0 0 1120 700' width='100%'><g {style}>")
    for r in points.select("x", "y", "cluster", "text").toLocalIterator(prefetchPartitions=True):
        x, y = 20 + 960 * (r["x"] - box["minx"]) / span_x, 680 - 660 * (r["y"] - box["miny"]) / span_y
        out.write(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{radius}" fill="{colours[r["cluster"]]}"><title>{html.escape(r["text"] or "")}</title></circle>')
    out.write("</g>")
    for n, label in enumerate(labels):
        name = "unlabelled" if label is None else f"cluster {label}"
        out.write(f'<text x="1000" y="{30 + 18 * n}" fill="{colours[label]}" font-size="13">{name}</text>')
    out.write("</svg>")
    return box["n"]


def plot(points: DataFrame, title: str = "Clusters") -> str:
    """The page as a string."""
    out = io.StringIO()
    plot_to(points, out, title)
    return out.getvalue()
