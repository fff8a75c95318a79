"""The neighbour graph against exact search, and the layout made from it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlight.operators import dense, neighbours, project


def frame(spark, matrix, name=lambda i: i):
    rows = [(name(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"vec_id {'string' if isinstance(name(0), str) else 'long'}, embedding array<double>")


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def share(graph, matrix, k, name=lambda i: i):
    """The share of each row's k best scores that the graph reaches."""
    u = unit(matrix)
    scores = u @ u.T
    np.fill_diagonal(scores, -np.inf)
    least = np.sort(scores, axis=1)[:, -k]
    place = {name(i): i for i in range(len(matrix))}
    return sum(scores[place[r["id"]], place[r["neighbour"]]] >= least[place[r["id"]]] - 1e-5 for r in graph) / (k * len(matrix))


def test_recall_over_the_table(spark, sf):
    """Vectors that spread in all directions, in leaves of a sixteenth of them."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    truth = dense.exact_many(table, asked, 11).where("query_id <> id").groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False)[9].alias("least"))
    found = neighbours.graph(table, 10, leaf=32)
    hits = found.join(truth, F.col("id") == F.col("query_id")).where("score >= least - 0.00001").count()
    assert hits >= 0.9 * 10 * table.count()
    assert found.groupBy("id").count().where("count <> 10").isEmpty() and found.where("id = neighbour").isEmpty()
    assert found.select("id", "neighbour").distinct().count() == found.count() == 10 * table.count()


def test_copies_and_text_ids(spark):
    """A third of the rows are one vector; it doesn't name the same few neighbours everywhere."""
    rng = np.random.default_rng(3)
    matrix = np.concatenate([np.ones((150, 8)), rng.standard_normal((300, 8))])
    name = lambda i: f"row {i:04d}"
    found = neighbours.graph(frame(spark, matrix, name), 5, leaf=16).collect()
    assert share(found, matrix, 5, name) >= 0.95
    named = [r["neighbour"] for r in found if r["id"] < "row 0150"]
    assert max(named.count(x) for x in set(named)) < 40


def test_start_finds_most(spark):
    """Vectors without structure: the leaves that are compared at once find most neighbours before any round."""
    matrix = np.random.default_rng(11).standard_normal((3000, 24))
    found = neighbours.graph(frame(spark, matrix), 10, leaf=32, rounds=0).collect()
    assert share(found, matrix, 10) >= 0.8
    assert share(neighbours.graph(frame(spark, matrix), 10, leaf=32).collect(), matrix, 10) >= 0.97


def test_highest_scores():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (40, 40), (333, 10), (1601, 15)):
        scores = np.round(rng.standard_normal((50, n)), 1)
        best = neighbours.highest(scores, m)
        assert all(len(set(row)) == m for row in best.tolist())
        assert (np.sort(np.take_along_axis(scores, best, axis=1)) == np.sort(scores, axis=1)[:, n - m :]).all()


def test_groups_go_over_batches():
    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4]
    for cuts in ((), (2,), (1, 4), (3, 5, 6), range(1, 9), (4, 4)):
        at = [0, *cuts, len(keys)]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64())], names=["a"]) for a, b in zip(at, at[1:])]
        groups = []
        for table, ends in neighbours._runs(batches, 0):
            ends = ends.tolist()
            assert ends[-1] == table.num_rows
            groups += [table["a"].to_pylist()[a:b] for a, b in zip([0, *ends], ends)]
        assert groups == [[1, 1], [2] * 4, [3], [4, 4]]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.1])]
    found = neighbours.graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()
    assert {r["id"] for r in found} == {1, 2, 3, 4, 5, 6} and {(r["id"], r["neighbour"]) for r in found if r["rank"] == 1} >= {(1, 6), (6, 1), (4, 6)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.graph(empty, 3).collect() == [] and project.umap(empty, "vec_id").collect() == []
    assert neighbours.graph(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 3).collect() == []
    with pytest.raises(ValueError):
        neighbours.graph(empty, 0)


def trustworthiness(matrix, flat, k=10):
    """Venna and Kaski's measure: 1 if all neighbours in the plane are neighbours in space."""
    u, n = unit(matrix), len(matrix)
    away = 1 - u @ u.T
    np.fill_diagonal(away, np.inf)
    rank = np.argsort(np.argsort(away, axis=1), axis=1) + 1
    apart = ((flat[:, None] - flat[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()


def test_umap_is_trustworthy(spark):
    """Clusters, and a band along a circle, that two components can't part, in several blocks."""
    rng = np.random.default_rng(5)
    centres = 3 * np.eye(12)
    blobs = np.concatenate([c + 0.3 * rng.standard_normal((50, 12)) for c in centres])
    turn = rng.uniform(0, 2 * np.pi, 300)
    band = np.stack([np.cos(turn), np.sin(turn), *(0.05 * rng.standard_normal((10, 300)))], axis=1) - 2 * np.eye(12)[11]
    matrix = np.concatenate([blobs, band])
    table = frame(spark, matrix)
    places = {r["id"]: (r["x"], r["y"]) for r in project.umap(table, "vec_id", block=128).collect()}
    flat = np.array([places[i] for i in range(len(matrix))])
    pca = {r["id"]: (r["x"], r["y"]) for r in project.pca(table, "vec_id").collect()}
    known, before = trustworthiness(matrix, flat), trustworthiness(matrix, np.array([pca[i] for i in range(len(matrix))]))
    assert len(places) == len(matrix) and known > 0.93 and known > before + 0.05, (known, before)
    kind = np.repeat(np.arange(12), 50)
    apart = ((flat[:600, None] - flat[None, :600]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert (kind[np.argsort(apart, axis=1)[:, :10]] == kind[:, None]).mean() > 0.95


def test_fuzzy_union(spark):
    near = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.5, 2), (2, 1, 0.9, 1), (3, 1, 0.5, 1)], "id long, neighbour long, score double, rank long")
    edges = {(r["id"], r["other"]): r["weight"] for r in project.fuzzy_union(near).collect()}
    assert set(edges) == {(1, 2), (2, 1), (1, 3), (3, 1)} and edges[1, 2] == edges[2, 1] == 1.0
    assert edges[1, 3] == edges[3, 1] and 0 < edges[1, 3] <= 1
