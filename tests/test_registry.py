"""Every registered query against its SQL on the smallest tables."""

import glob
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from siftlight.functions.stop_words import ENGLISH
from siftlight.operators.embed import HashingEmbedder
from siftlight.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def recall(spark, sf, rows):
    truth = registry.queries()["dense_topk_many"](spark, sf).collect()
    return len({(r["query_id"], r["id"]) for r in truth} & {(r["query_id"], r["id"]) for r in rows}) / len(truth)


def test_queries_without_sql(spark, sf):
    """What SQL can't say, by other means."""
    run = lambda name: registry.queries()[name](spark, sf).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert recall(spark, sf, run("ann_ivf")) >= 0.9 and recall(spark, sf, run("ann_graph")) >= 0.9
    matrix, ids = np.stack([vectors[i] for i in sorted(vectors)]), sorted(vectors)
    found = {r["vec_id"]: r["cluster"] for r in run("kmeans_clusters")}
    groups = np.array([found[i] for i in ids])
    centres = np.stack([matrix[groups == k].mean(axis=0) for k in range(10)])
    away = ((matrix[:, None] - centres) ** 2).sum(axis=2)
    assert set(found) == set(ids) and (away.argmin(axis=1) == groups).mean() > 0.99  # each is with its nearest mean
    swept = run("kmeans_sweep")
    assert [r["k"] for r in sorted(swept)] == list(range(2, 21)) and all(-1 <= r["silhouette"] <= 1 for r in swept)
    by_k = {r["k"]: r for r in swept}
    assert by_k[20]["inertia"] < by_k[2]["inertia"] and by_k[10]["inertia"] <= 1.001 * away.min(axis=1).sum()
    flat = {r["id"]: (r["x"], r["y"]) for r in run("pca_projection")}
    _, _, axes = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([flat[i] for i in ids]), np.abs(matrix @ axes[:2].T), atol=1e-6)
    assert {r["id"] for r in run("umap_projection")} == set(ids)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = unit @ unit.T - 2 * np.eye(len(ids))
    least, place = np.sort(scores, axis=1)[:, -10], {x: i for i, x in enumerate(ids)}
    near = run("knn_graph")
    assert sum(scores[place[r["id"]], place[r["neighbour"]]] >= least[place[r["id"]]] - 1e-5 for r in near) >= 0.9 * len(near) == 0.9 * 10 * len(ids)
    picked = [r["vec_id"] for r in run("subsample")]
    assert len(set(picked)) == 100 and set(picked) <= set(ids)
    made = {r["doc_id"]: r for r in run("hashing_embeddings")}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = HashingEmbedder(64).encode([r["text"]])[0]
        assert made[r["doc_id"]]["dim"] == 64 and abs(made[r["doc_id"]]["norm"] - np.linalg.norm(want)) < 1e-3
        assert made[r["doc_id"]]["digest"] == hashlib.sha256(",".join(f"{x + 0.0:.4f}" for x in want.astype(float)).encode()).hexdigest()
    learned = {r["doc_id"]: np.array(r["embedding"]) for r in run("latent_embeddings")}
    assert all(len(v) == 64 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in learned.values())
    for r in run("latent_search"):
        assert abs(learned[r["query_id"]] @ learned[r["id"]] - r["score"]) < 1e-5 and r["query_id"] % 100 == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    truth = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert len(rows) == len(truth)
    for a, b in zip(sorted(rows, key=_key), sorted(truth, key=_key)):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b)), (a, b)


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_entry_and_training_queries_are_apart(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
