import math

import numpy as np
import pytest

from siftlight import cli
from siftlight.operators import cluster, project
from siftlight.plans import measure


def blobs(spark, n=60, k=3, d=8):
    rng = np.random.default_rng(0)
    centres = np.eye(d)[:k]
    rows = [(i, (centres[i % k] + rng.normal(scale=0.05, size=d)).tolist(), i % k, f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, truth int, text string")


def test_kmeans_and_sizes(spark):
    df = blobs(spark)
    found = cluster.kmeans(df, 3, inits=2).persist()
    pairs = {(r["truth"], r["cluster"]) for r in found.select("truth", "cluster").distinct().collect()}
    assert len(pairs) == 3
    assert sorted(r["n"] for r in cluster.sizes(found, 4).collect()) == [0, 20, 20, 20]
    members = cluster.members(found, 3, first=2).collect()
    assert all(len(r["first_members"]) == 2 and r["n"] == 20 for r in members)
    assert cluster.silhouette(found) > 0.9
    assert math.isnan(cluster.silhouette(found.where("truth = 0")))
    with pytest.raises(ValueError):
        cluster.kmeans(df, 61)


def test_sweep_and_report(spark):
    rows = cluster.sweep(blobs(spark), 2, 5, inits=2)
    assert cluster.best_k(rows).k == 3 and "k=3" in cluster.report(rows)
    with pytest.raises(ValueError):
        cluster.sweep(blobs(spark), 2, 60)
    with pytest.raises(ValueError):
        cluster.sweep(blobs(spark), 1, 5)
    none = spark.createDataFrame([(2, math.nan, 1.0, 1)], "k int, silhouette double, inertia double, smallest int")
    assert cluster.best_k(none) is None


def test_subsample(spark):
    df = blobs(spark)
    a = {r["id"] for r in cluster.subsample(df, 10).collect()}
    assert len(a) == 10 and a == {r["id"] for r in cluster.subsample(df.repartition(7), 10).collect()}
    assert cluster.subsample(df, 0).count() == 60


def test_layout_keeps_clusters_apart(spark):
    df = blobs(spark)
    places = {r["id"]: (r["x"], r["y"]) for r in project.umap(df).collect()}
    assert len(places) == 60
    xy = np.array([places[i] for i in range(60)])
    centres = np.stack([xy[k::3].mean(axis=0) for k in range(3)])
    own = np.linalg.norm(xy - centres[np.arange(60) % 3], axis=1).mean()
    apart = min(np.linalg.norm(centres[a] - centres[b]) for a in range(3) for b in range(a))
    assert apart > 2 * own
    assert project.pca(df).count() == 60


def test_plot(spark):
    points = spark.createDataFrame([(0.0, 1.0, 2, "a <b>"), (1.0, 0.0, 10, "c"), (2.0, 2.0, None, None)], "x double, y double, cluster int, text string")
    page = project.plot(points)
    assert page.index("cluster 2") < page.index("cluster 10") and "unlabelled" in page and "a &lt;b&gt;" in page


def test_percentiles_by_ranges(spark):
    from siftlight.functions import stats

    values = [float((i * 7919) % 1009) for i in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ranked = sorted(values)
    want = [ranked[max(1, math.ceil(len(values) * p / 100)) - 1] for p in (0, 10, 50, 99.5, 100)]
    for small, cuts in ((300, 10), (10_000, 100)):
        assert list(stats.percentiles(df, "x", (0, 10, 50, 99.5, 100), small, cuts).first()) == want
    assert list(stats.percentiles(df.where("x < 0"), "x", (50,)).first()) == [None]


def test_measure(spark):
    row = measure.bench(spark, lambda: None, runs=5, warm_ups=1).first()
    assert row["best"] <= row["p50"] <= row["max"]
    assert measure.cycled(["a", "b"], 5) == ["a", "b", "a", "b", "a"]
    assert "1,000 vectors: 256,000 B (250.00 KiB)" in measure.report(spark, {}, 64)


def test_cli(spark, tmp_path):
    for i, words in enumerate(("rain storm cloud", "bread butter salt", "stock market bond")):
        (tmp_path / f"{i}.txt").write_text(". ".join(f"{w.title()} number {j} here" for j, w in enumerate(words.split() * 3)) + ".")
    store = str(tmp_path / "store")
    run = lambda *a: cli.main(list(a), spark)
    assert "chunks" in run("ingest", str(tmp_path), "--max-chars", "60", "--overlap", "0")
    assert "0 dropped" in run("ingest", str(tmp_path), "--store", store, "--max-chars", "60", "--overlap", "0", "--model", "hashing-32", "--out", str(tmp_path / "md"))
    assert "0 embedded" in run("ingest", str(tmp_path), "--store", store, "--max-chars", "60", "--overlap", "0", "--model", "hashing-32")
    assert "Bread" in run("search", "bread butter", "--store", store, "--model", "hashing-32", "--k", "1", "--rerank", "--rerank-model", "overlap")
    assert "Rain" in run("search", "rain", "--store", store, "--method", "lexical", "--k", "1")
    with pytest.raises(SystemExit):
        run("visualize", "--store", store, "--out", str(tmp_path / "x.html"))
    assert "cluster 1" in run("cluster", "--store", store, "--k", "2")
    assert run("search", "rain", "--store", store, "--model", "hashing-32", "--method", "dense", "--k", "2", "--ef", "9") == run("search", "rain", "--store", store, "--model", "hashing-32", "--method", "dense", "--k", "2", "--ef", "9")
    assert run("search", "bread", "--store", store, "--method", "lexical", "--where", "text LIKE 'Rain%'").count("Rain") >= 1
    (tmp_path / "e.json").write_text('{"id": 1, "text": "nothing like it"}\n')
    assert "1 entries written, 1 without a cluster" in run("cluster", "--store", store, "--k", "2", "--entries", str(tmp_path / "e.json"), "--out", str(tmp_path / "labelled"))
    (tmp_path / "nothing").mkdir()
    with pytest.raises(SystemExit):
        run("ingest", str(tmp_path / "nothing"), "--store", store)
    assert "k=" in run("sweep", "--store", store, "--max-k", "3")
    run("visualize", "--store", store, "--out", str(tmp_path / "x.html"))
    assert "<svg" in (tmp_path / "x.html").read_text()
    assert "minilm" in run("models")
    (tmp_path / "in.md").write_text("# Documents\n- one thing\n- another thing\n# Query\nthing")
    assert run("load", str(tmp_path / "in.md"), "--store", store, "--model", "hashing-32", "--full", str(tmp_path / "full")) == "2 documents"
    page = run("bench", "--store", store, "--query", "thing", "--runs", "1", "--model", "hashing-32")
    assert "hybrid" in page and "Embedding by batch size" in page and "| 100 |" in page and "p50" in page


def test_fits_go_on_together_as_mllib_fits_alone(spark, monkeypatch):
    """The labels and costs of MLlib's own fits, by as many scans as the longest fit has rounds."""
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 5)))], "id long, embedding array<float>").repartition(3, "id").persist()
    table = cluster._features(df, "embedding").persist()
    models = {(k, s): KMeans(k=k, seed=s, maxIter=300, featuresCol="_v", predictionCol="cluster").fit(table) for k in (2, 5, 9) for s in (42, 43)}
    scans, scan = [], cluster._scanned
    monkeypatch.setattr(cluster, "_scanned", lambda packed, centres, tasks: scans.append(len(centres)) or scan(packed, centres, tasks))
    fits = cluster._fit(table, list(models), 300, "embedding")
    assert scans == sorted(scans, reverse=True) and len(scans) == max(m.summary.numIter for m in models.values())
    for fit, m in zip(fits, models.values()):
        assert np.allclose(fit.centres, m.clusterCenters(), atol=1e-9) and math.isclose(fit.cost, m.summary.trainingCost, rel_tol=1e-9)
    want = {r["id"]: r["cluster"] for r in min((m for (k, _), m in models.items() if k == 5), key=lambda m: m.summary.trainingCost).transform(table).collect()}
    assert {r["id"]: r["cluster"] for r in cluster.kmeans(df, 5, inits=2).collect()} == want
    # Sums that executors add up first are the same.
    packed, centres = cluster._packed(table, "embedding"), [f.centres for f in fits]
    for a, b in zip(scan(packed, centres, 8), scan(packed, centres, 8, room=0)):
        assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all() and math.isclose(a[2], b[2])
