"""Walks over proximity graphs against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlight.operators import dense, search
from siftlight.operators.graph_index import GraphIndex, linked, walk


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def blobs(n=1200, kinds=6, d=16):
    """Clusters far from each other, so that near neighbours alone don't lead from one to the next."""
    rng = np.random.default_rng(2)
    return np.concatenate([20 * np.eye(d)[i] + rng.standard_normal((n // kinds, d)) for i in range(kinds)])


def exact(v, asked, k, some=None):
    scores = np.round(asked @ v.T, 6)
    if some is not None:
        scores[:, ~some] = -np.inf
    return np.sort(scores, axis=1)[:, -k:][:, ::-1]


def test_walk_finds_and_skips():
    v = unit(blobs()).astype(np.float32)
    links = linked(v, 16, 32, 1.2, 1)
    assert links.shape == (len(v), 16) and (links[:, :-2] != np.arange(len(v))[:, None]).all()
    places, scores, looked = walk(v, links, v[::10], 10, 40, None, 1)
    assert looked < 0.5 * len(v) * len(v[::10])
    assert (np.abs(scores - exact(v, v[::10], 10)) < 1e-5).mean() > 0.95 and (places[:, 0] == np.arange(0, len(v), 10)).mean() > 0.99
    some = np.arange(len(v)) % 2 == 0
    places, scores, looked = walk(v, links, v[1::20], 10, 40, np.flatnonzero(some), 1)
    assert looked < 0.8 * len(v) * len(v[1::20]) and (places % 2 == 0).all()
    assert (np.abs(scores - exact(v, v[1::20], 10, some)) < 1e-5).mean() > 0.9
    few = np.array([7, 400, 900])
    places, scores, _ = walk(v, links, v[:5], 10, 40, few, 1)
    assert places.shape == (5, 3) and set(places.ravel()) == {7, 400, 900}


def test_recall_over_the_table(spark, sf, tmp_path):
    """All rows are in the index; each row whose id is divisible by 10 asks all of them."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = table.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    truth = dense.exact_many(table, asked, 10)
    for name, rows in (("one", None), ("many", 90)):
        index = GraphIndex.create(table, f"{tmp_path}/{name}", shard_rows=rows)
        assert index.shards.agg(F.sum(F.size("ids"))).first()[0] == table.count() == index.rows.count()
        found = index.search_many(asked, 10, ef=64)
        assert found.count() == truth.count() and dense.recall(found, truth) >= 0.9
    near = table.where("label < 3")
    want = dense.exact_many(near, asked, 10)
    for index in (index.where("label < 3"), GraphIndex.read(spark, f"{tmp_path}/one").where("label < 9").where("label < 3")):
        found = index.search_many(asked, 10, ef=64)
        assert found.join(near, found.id == near.vec_id, "left_anti").isEmpty() and dense.recall(found, want) >= 0.9
    assert index.where("label = 77").search_many(asked, 10).isEmpty()


def test_odd_tables(spark, tmp_path):
    rows = [("a", [1.0, 0.0], 1), ("b", None, 2), ("c", [1.0], 1), ("d", [0.0, 2.0], 2), ("e", [None, 1.0], 1), ("f", [3.0, 3.0], 2)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>, id int")
    index = GraphIndex.create(table, f"{tmp_path}/odd")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in index.search_many(asked, 6).collect()}
    assert found[1, 1] == ("d", 1.0) and found[1, 2] == ("f", pytest.approx(0.707107, abs=1e-6)) and len(found) == 12
    assert {s for (q, _), (_, s) in found.items() if q == 2} == {0.0}
    assert [r["id"] for r in index.where("id = 2").search([1.0, 1.0], 2).orderBy("rank").collect()] == ["f", "d"]
    empty = GraphIndex.create(table.limit(0), f"{tmp_path}/empty")
    assert empty.search_many(asked, 3).isEmpty() and index.search_many(asked.limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        index.search_many(asked, 0)


class Given:
    dim, model_id = 16, "given"

    def encode(self, texts):
        return np.array([[1.0] * 16 for _ in texts])


def test_searcher_takes_conditions_with_an_index(spark, tmp_path):
    table = frame(spark, blobs(240)).select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("text "), "vec_id").alias("text"), (F.col("vec_id") % 3).alias("kind"))
    index = GraphIndex.create(table, f"{tmp_path}/g", id_col="id")
    with_index, plain = search.Searcher(table, Given(), index=index), search.Searcher(table, Given())
    for method in ("dense", "hybrid", "weighted", "mmr"):
        a, b = (s.search("text 9", method, 5, 20, where="kind = 0", ef=60).select("rank", "id").orderBy("rank").collect() for s in (with_index, plain))
        assert a == b and all(r["id"] % 3 == 0 for r in a), method
