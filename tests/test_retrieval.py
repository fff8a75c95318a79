import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlight.operators import dense, embed, fusion, lexical
from siftlight.operators.search import METHODS, Searcher, shown


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


def bm25_plain(texts, query):
    cut = [t.split() for t in texts]
    n, avg = len(cut), sum(map(len, cut)) / len(cut)
    df = Counter(t for c in cut for t in set(c))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for c in cut:
        s = 0.0
        for q in query.split():
            tf = c.count(q)
            if tf:
                s += (idf[q] if idf[q] >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c) / avg))
        out.append(s)
    return out


def test_bm25_against_plain_python(spark):
    texts = ["a b c", "a a d", "a b", "e f a", "b b b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for query in ("a", "b b d", "zz", "a zz e"):
        found = scores(lexical.bm25_scores(df, query))
        assert [found[i] for i in range(5)] == pytest.approx(bm25_plain(texts, query))
    top = lexical.bm25(df, "zz", 3).collect()
    assert [(r["id"], r["score"], r["rank"]) for r in top] == [(0, 0.0, 1), (1, 0.0, 2), (2, 0.0, 3)]


def test_index_scores_like_the_scan(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = lexical.LexicalIndex.create(docs, str(tmp_path / "i"), buckets=4)
    for query in ("the of license version", "zzzz", "", "mit mit the"):
        want = [(r["id"], pytest.approx(r["score"])) for r in lexical.bm25(docs, query, 8).orderBy("rank").collect()]
        assert [(r["id"], r["score"]) for r in index.search(query, 8).orderBy("rank").collect()] == want
    assert index.search("zzzz", 8, drop_zero=True).count() == 0
    plan = index.postings.where("bucket = 1 AND term = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,x)" in plan


def test_lexical_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.bm25_scores(empty, "a").count() == 0
    assert lexical.tfidf_scores(empty, "a").count() == 0
    stops = spark.createDataFrame([(1, "the and of"), (2, None)], "doc_id long, text string")
    assert set(scores(lexical.tfidf_scores(stops, "the")).values()) == {0.0}
    with pytest.raises(ValueError):
        lexical.bm25(stops, "a", 0)


def test_tfidf_is_a_cosine(spark):
    texts = ["alpha beta", "alpha alpha", "gamma delta beta"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scores(lexical.tfidf_scores(df, "alpha beta"))
    assert found[0] == pytest.approx(1.0) and 0 < found[2] < found[1] < 1


def test_dense_exact_and_many(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = rows.orderBy("vec_id").toPandas()
    m = np.stack(data["embedding"]).astype(float)
    q = m[3] + m[10] + m[77]
    cosine = np.round(m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q), 6)
    want = sorted(zip(-cosine, data["vec_id"]))[:7]
    got = dense.exact(rows, q.tolist(), 7).orderBy("rank").collect()
    assert [r["id"] for r in got] == [i for _, i in want]
    asked = spark.createDataFrame([(1, q.tolist()), (2, m[5].tolist())], "query_id long, vector array<double>")
    many = dense.exact_many(rows, asked, 7, block=1).where("query_id = 1").orderBy("rank").collect()
    assert [r["id"] for r in many] == [i for _, i in want]
    with pytest.raises(ValueError):
        dense.exact(rows, [1.0], 3)


def test_approximate_recall(spark, sf, tmp_path):
    """Every row whose id is divisible by 100 asks all rows, with the registered settings."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    truth = dense.exact_many(rows, asked, 10)
    index = dense.IvfIndex.create(rows, str(tmp_path / "i"))
    found = index.search_many(asked, 10)
    assert found.count() == truth.count() and dense.recall(found, truth) >= 0.9
    everything = index.search_many(asked, 10, probe=len(index.centres))
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, truth.collect()))
    q = rows.where("vec_id = 100").first()["embedding"]
    one = truth.where("query_id = 100").drop("query_id")
    assert dense.recall(index.search(q, 10, ef=len(index.sizes) and rows.count()), one) == 1.0
    assert dense.recall(index.search(q, 10, ef=200), one) >= 0.7 and index.search(q, 10, ef=1).count() == 10


def test_unsound_vectors_count_as_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.6, 0.8])], "vec_id long, embedding array<double>")
    want = {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.6}
    assert scores(dense.cosine_scores(rows, [2.0, 0.0])) == pytest.approx(want)
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    many = dense.exact_many(rows, asked, 6, room=16)
    assert scores(many.where("query_id = 7")) == pytest.approx(want) and set(scores(many.where("query_id = 8")).values()) == {0.0}
    assert dense.exact_many(rows, asked.limit(0), 6).count() == 0


def ranked(spark, pairs):
    return spark.createDataFrame([(i, float(s), r) for r, (i, s) in enumerate(pairs, 1)], "id long, score double, rank long")


def test_fusion(spark):
    a, b = ranked(spark, [(1, 9), (2, 5), (3, 1)]), ranked(spark, [(3, 8), (4, 2)])
    rrf = fusion.reciprocal_rank([a, b], 4).orderBy("rank").collect()
    assert [r["id"] for r in rrf] == [3, 1, 2, 4]
    assert rrf[0]["score"] == pytest.approx(1 / 63 + 1 / 61)
    mixed = scores(fusion.weighted(a, b))
    assert mixed == pytest.approx({1: 0.5, 2: 0.25, 3: 0.5, 4: 0.0})
    assert set(scores(fusion.minmax(ranked(spark, [(1, 2), (2, 2)]))).values()) == {0.0}
    nothing = spark.createDataFrame([], "id long, score double, rank long")
    assert fusion.minmax(nothing).count() == 0
    assert fusion.reciprocal_rank([a, nothing], 5).count() == 3


def mmr_plain(pool, k, trade):
    picked, out = [], []
    while len(out) < min(k, len(pool)):
        gains = [(-round(trade * s - (1 - trade) * max((float(np.dot(v, pool[j][2])) for j in picked), default=0.0), 12), i) for i, (_, s, v) in enumerate(pool) if i not in picked]
        best = min(gains)[1]
        picked.append(best)
        out.append(pool[best][0])
    return out


@pytest.mark.parametrize("trade", [1.0, 0.75, 0.5, 0.25, 0.0])
def test_mmr_against_plain_python(spark, trade):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[:3].sum(axis=0)
    s = np.round(v @ q / np.linalg.norm(q), 6)
    pool = sorted([(i, float(s[i]), v[i].tolist()) for i in range(20)], key=lambda x: (-x[1], x[0]))
    df = spark.createDataFrame(pool, "id long, score double, vector array<double>")
    assert [r["id"] for r in fusion.mmr(df, 8, trade).orderBy("rank").collect()] == mmr_plain(pool, 8, trade)
    assert fusion.mmr(df, 50, trade).count() == 20


def test_every_method(spark):
    texts = ["rain and storm clouds", "heavy rain tomorrow", "a recipe for bread", "bread and butter", "stock market falls"]
    e = embed.HashingEmbedder(64)
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, source string")
    searcher = Searcher(embed.embed(rows, e), e)
    for method in METHODS:
        found = searcher.search("rain storm", method, k=2).collect()
        assert [r["rank"] for r in found] == [1, 2] and found[0]["id"] == 0, method
    again = searcher.search("bread recipe", "hybrid", k=1, candidates=4, do_rerank=True).collect()
    assert again[0]["id"] == 2 and again[0]["score"] == 1.0
    assert shown(searcher.search("rain", "dense", 1)).first()["source"] == "s"
    assert {r["id"] for r in searcher.search("rain storm", "lexical", k=5, where="id > 2").collect()} == {3, 4}
    with pytest.raises(ValueError):
        searcher.search("x", "other")
    with pytest.raises(ValueError):
        searcher.search("x", "dense", k=0)


def test_embedders(spark):
    e = embed.HashingEmbedder(32)
    v = e.encode(["a b", "", "a b"])
    assert (v[0] == v[2]).all() and not v[1].any() and np.linalg.norm(v[0]) == pytest.approx(1)
    assert embed.resolve("minilm").dim == 384 and embed.resolve("some/model").model_id == "some/model"
    df = spark.createDataFrame([(None,), ("x",)], "text string")
    assert embed.embed(df, e).where(F.size("embedding") == 32).count() == 2


def test_text_ids_and_many_lists(spark, tmp_path):
    """Ids of the store's kind; more lists than any plan could hold as literals."""
    rng = np.random.default_rng(4)
    rows = [(f"row {i:05d}", rng.standard_normal(6).tolist(), 3) for i in range(6000)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>, list_of int")
    asked = table.where("substring(vec_id, 8) = '00'").selectExpr("vec_id AS query_id", "embedding AS vector")
    truth = dense.exact_many(table, asked, 5)
    m = np.array([v for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(f"row {i:05d}", f"row {j:05d}") for i in range(0, 6000, 100) for j in np.argsort(-np.round(m[i] @ m.T, 6), kind="stable")[:5]}
    assert {(r["query_id"], r["id"]) for r in truth.collect()} == want
    index = dense.IvfIndex.create(table, str(tmp_path / "i"), lists=2500)
    assert len(index.centres) > 2000 and sum(index.sizes.values()) == 6000
    found = index.search_many(asked, 5)
    assert dense.recall(found, truth) >= 0.9
    assert len(found._jdf.queryExecution().toString()) < 50_000


def test_scans_sort_only_what_reaches_the_best(monkeypatch):
    """Of 64 x 20,480 scores, with ties, little is sorted, and the best are those of a full sort."""
    rng = np.random.default_rng(3)
    scores, ids = np.round(rng.normal(size=(64, 20_480)), 3), rng.permutation(20_480)
    best, which, cells, sort = dense._Best(64, 10, ids.dtype), np.arange(64), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **a: cells.append(keys[0].size) or sort(keys, **a))
    for at in range(0, 20_480, 1024):
        best.add(which, scores[:, at : at + 1024], ids[at : at + 1024])
    assert sum(cells) < scores.size / 20
    for q in which:
        order = sort((ids, -scores[q]))[:10]
        assert best.ids[q].tolist() == ids[order].tolist() and best.scores[q].tolist() == scores[q, order].tolist()


def test_a_row_goes_to_python_once_for_many_blocks_of_queries(spark, tmp_path):
    """Rows aren't joined to blocks of queries, of which there are as many as the queries have partitions."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 6)))], "vec_id long, embedding array<float>")
    asked = rows.where("vec_id % 10 = 0").selectExpr("CAST(vec_id AS string) AS query_id", "embedding AS vector").repartition(12)
    found = dense.exact_many(rows, asked, 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    m = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    assert got == {(str(q), j + 1): x for q in range(0, 600, 10) for j, x in enumerate(np.lexsort((np.arange(600), -np.round(m @ m[q], 6)))[:5].tolist())}
    assert {(r["query_id"], r["rank"]): r["id"] for r in dense.exact_many(rows, asked, 5, room=300).collect()} == got
    index = dense.IvfIndex.create(rows, str(tmp_path / "i"), lists=9)
    for room in (1 << 20, 300):
        assert {(r["query_id"], r["rank"]): r["id"] for r in index.search_many(asked, 5, probe=len(index.centres), room=room).collect()} == got


def test_searcher_joins_no_texts_to_vectors(spark, tmp_path):
    """With vectors kept apart every method finds what it finds in one table, and no plan of vectors has texts."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5} text {'more ' * (i % 3)}", "s") for i in range(40)], "id long, text string, source string")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(range(0, 60, 2), rng.normal(size=(30, 16)))], "id long, embedding array<double>")
    e = embed.HashingEmbedder(16)
    one, apart = Searcher(rows.join(vectors, "id", "left"), e), Searcher(rows, e, vectors=vectors)
    assert "text:string" not in apart._embedded._jdf.queryExecution().executedPlan().toString()
    for method in METHODS:
        for where in (None, "id > 9"):
            want = list(map(tuple, one.search("word3 more text", method, 6, 12, where=where).collect()))
            assert list(map(tuple, apart.search("word3 more text", method, 6, 12, where=where).collect())) == want, method


def test_tfidf_weighs_only_documents_with_a_term_of_the_query(spark):
    """Of documents without one no terms are joined to their idfs; a term within a longer word is none."""
    rows = [(i, f"alpha common{i}") for i in range(3)] + [(i, f"alphabet filler{i} other{i} more{i}") for i in range(3, 60)] + [(60, None), (61, "Alpha alpha BETA")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lexical.tfidf_scores(df, "alpha beta").persist()
    assert {r["id"] for r in found.where("score > 0").collect()} == {0, 1, 2, 61} and found.count() == 62
    a, b, c = (np.log(63 / (1 + df)) + 1 for df in (4, 1, 1))
    got = scores(found)
    assert got[0] == pytest.approx(a * a / np.hypot(a, c) / np.hypot(a, b)) and got[61] == pytest.approx((2 * a * a + b * b) / np.hypot(2 * a, b) / np.hypot(a, b))
    assert "arrays_overlap" in lexical.tfidf_scores(df, "alpha beta")._jdf.queryExecution().optimizedPlan().toString()
