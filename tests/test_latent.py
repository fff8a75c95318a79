"""Directions learned from the corpus against numpy's singular vectors, and what they find."""

import numpy as np
import pytest

from siftlight import cli
from siftlight.operators import embed, latent


def matrix(model, texts):
    out = np.zeros((len(texts), len(model.idf)))
    for i, t in enumerate(texts):
        columns, weights = model.weights(t)
        out[i, columns] = weights
    return out


def test_against_numpys_svd(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    model = latent.fit(docs, 12, terms=3000, spare=256, power=6)
    full = matrix(model, texts)
    _, values, axes = np.linalg.svd(full, full_matrices=False)
    assert len(model.terms) <= 3000 and model.dim == 12 and np.allclose(model.axes.T @ model.axes, np.eye(12), atol=1e-4)
    kept = ((full @ model.axes) ** 2).sum()
    assert kept > 0.999 * (values[:12] ** 2).sum()
    assert np.allclose(np.linalg.norm(full @ model.axes, axis=0), values[:12], rtol=0.01)
    first = np.abs(np.diag(axes[:4] @ model.axes[:, :4]))
    assert (first > 0.99).all(), first  # each direction, up to its sign
    exact = full @ axes[:12].T
    exact /= np.maximum(np.linalg.norm(exact, axis=1, keepdims=True), 1e-12)
    made = model.encode(texts)
    assert np.abs(made @ made.T - exact @ exact.T).mean() < 0.02


def test_counts_and_idf(spark):
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "aa cc"), (3, None), (4, "AA dd é ñandú x")], "id long, text string")
    model = latent.fit(docs, 2, terms=2, spare=3)
    assert model.terms == ["aa"]  # the others tie, and together they are too many
    whole = latent.fit(docs, 2, terms=50, spare=3)
    assert whole.terms == ["aa", "bb", "cc", "dd", "ñandú"]
    assert np.allclose(whole.idf[:5], np.log(5 / (1 + np.array([3, 1, 1, 1, 1]))) + 1)
    columns, weights = whole.weights("bb BB aa zz")
    assert columns.tolist()[:2] == [0, 1] and columns[2] >= 5 and np.isclose(np.linalg.norm(weights), 1)
    assert weights[1] / weights[0] == pytest.approx((1 + np.log(2)) * whole.idf[1] / whole.idf[0])


def topics(n=240, kinds=8):
    """Texts of a topic draw a few of its words; many have none in common."""
    rng = np.random.default_rng(11)
    return [(i, " ".join(f"topic{i % kinds}word{w}" for w in rng.choice(24, 5, replace=False)) + " " + " ".join(f"common{w}" for w in rng.choice(30, 8))) for i in range(n)]


def precision(vectors, kinds=8, k=5):
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, :k]
    return (near % kinds == (np.arange(len(vectors)) % kinds)[:, None]).mean()


def test_topics_are_found(spark):
    rows = topics()
    model = latent.fit(spark.createDataFrame(rows, "id long, text string").repartition(3), 10)
    texts = [t for _, t in rows]
    known, hashed = precision(model.encode(texts)), precision(embed.HashingEmbedder(256).encode(texts))
    assert known > 0.9 and known > hashed + 0.1, (known, hashed)


def test_kept_and_applied(spark, tmp_path):
    docs = spark.createDataFrame(topics(40), "id long, text string")
    model = latent.fit(docs, 6)
    model.save(spark, f"{tmp_path}/model")
    again = latent.LatentEmbedder.load(spark, f"{tmp_path}/model")
    assert again.model_id == model.model_id and again.terms == model.terms
    made = {r["id"]: r["embedding"] for r in embed.embed(docs, again).collect()}
    assert np.allclose([made[i] for i, _ in topics(40)], model.encode([t for _, t in topics(40)]), atol=1e-6)


def test_odd_tables(spark):
    empty = latent.fit(spark.createDataFrame([], "text string"), 4)
    assert empty.encode(["some words", ""]).shape == (2, 4)
    few = latent.fit(spark.createDataFrame([("one two",), (None,), ("",), ("one two",)], "text string"), 9, spare=1)
    made = few.encode(["one two", "", "a"])
    assert made.shape == (3, 9) and np.isclose(np.linalg.norm(made[0]), 1) and not made[1:].any()
    with pytest.raises(ValueError):
        latent.fit(spark.createDataFrame([], "text string"), 0)


def test_it_is_the_offline_default(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("SIFTLIGHT_MODEL", raising=False)
    monkeypatch.setattr(cli.importlib.util, "find_spec", lambda name: None)
    source, store = tmp_path / "docs", str(tmp_path / "store")
    source.mkdir()
    for i, text in topics(120):
        (source / f"{i}.txt").write_text(text)
    assert "120 embedded" in cli.main(["ingest", str(source), "--store", store], spark)
    said = cli.main(["search", "topic3word1 topic3word2 topic3word3", "--store", store, "--method", "dense", "--k", "3"], spark)
    assert said.count("topic3word") == 15
    (source / "new.txt").write_text("topic1word1 topic1word2 and a sentence of its own that is long enough to be kept by itself.")
    assert "1 embedded, 120 there already" in cli.main(["ingest", str(source), "--store", store, "--model", "latent"], spark)


def test_embedded_as_it_is_learned(spark, sf, monkeypatch):
    """Vectors come from the weights that were learned from: texts are cut twice, not three times."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    model, vectors = latent.fit_embed(docs, 8, terms=500)
    again = latent.fit(docs, 8, terms=500)
    assert again.terms == model.terms and np.allclose(again.axes, model.axes, atol=1e-4)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert made.keys() == texts.keys() and not any(made[-1]) and not any(made[-2])
    assert np.allclose([made[i] for i in texts], model.encode(list(texts.values())), atol=1e-5)


def test_words_of_any_text():
    texts = ["Kelvin ab_c-d1 é ñandú x yy", "a bb\x1fcc\x85dd", "İstanbul don't 日本語 x日", "", "étude 12 _ __"]
    assert [latent.words(t) for t in texts] == [latent._WORD.findall(t.lower()) for t in texts]
