"""The kept index against scans of the documents that are there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlight import cli
from siftlight.operators import lexical
from siftlight.operators.embed import HashingEmbedder
from siftlight.operators.sparse_index import SparseIndex, refreshed
from siftlight.sources.store import Store


def pairs(df):
    return [(r["id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_as_the_scan_after_changes(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text").persist()
    index = SparseIndex(spark, str(tmp_path / "i"), group=16)
    index.change(docs.where("id % 3 <> 0"), None)
    index.change(docs.where("id % 3 = 0"), docs.where("id % 3 = 1"))
    index.change(docs.where("id % 6 = 1"), None)  # some come back
    there = docs.where("id % 3 <> 1 OR id % 6 = 1")
    for query in ("the version of that license is and thati", "license", "the", "zzzz", ""):
        assert pairs(index.search(query, 10)) == pairs(lexical.bm25(there, query, 10, id_col="id")), query
    assert index.search("zzzz", 5, drop_zero=True).isEmpty()
    before = pairs(index.search("license text is", 7))
    index.merge()
    now = index.manifest()
    assert len(now["segments"]) == 1 and not now["gone"] and pairs(index.search("license text is", 7)) == before
    assert index.documents().count() == there.count() == now["n"]
    docs.unpersist()


def test_groups_are_skipped(spark, tmp_path):
    """A rare word in few documents: most groups can't reach what the best have."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(20, 60))) + (" rare rare rare" if i % 97 == 0 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = SparseIndex(spark, str(tmp_path / "i"), group=8)
    index.change(docs, None)
    told = {}
    assert pairs(index.search("rare w3", 5, told=told)) == pairs(lexical.bm25(docs, "rare w3", 5, id_col="id"))
    assert told["groups"] > 200 and told["skipped"] > 0.5 * told["groups"], told


def test_kept_with_the_store(spark, tmp_path):
    e, store = HashingEmbedder(4), Store(spark, str(tmp_path / "s"))
    texts = [f"common word{i % 7} only{i}" for i in range(30)]
    for some in (texts[:20], texts[5:25], texts[10:] + texts[:2]):
        store.ingest(spark.createDataFrame([(t,) for t in some], "text string"), e)
        index = refreshed(store)
        for query in ("word3 only12", "common only1", "only0"):
            want = lexical.bm25(store.read(), query, 6, id_col="chunk_hash")
            assert pairs(index.search(query, 6)) == pairs(want)
    segments = len(index.manifest()["segments"])
    assert segments == 3 and index.versions.last() == refreshed(store).versions.last()  # nothing new, nothing written
    said = [cli.main(["search", "common only12", "--store", store.root, "--method", "lexical", "--k", "3", *kept], spark) for kept in ([], ["--kept"])]
    assert said[0] == said[1] and "only12" in said[0]
    store.compact()
    assert pairs(refreshed(store).search("word3", 4)) == pairs(lexical.bm25(store.read(), "word3", 4, id_col="chunk_hash"))


def test_odd(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "i"))
    assert index.search("x", 3).isEmpty()
    index.change(spark.createDataFrame([("b", None), ("a", ""), ("c", "one")], "id string, text string"), None)
    assert pairs(index.search("one", 3)) == pairs(lexical.bm25(spark.createDataFrame([("b", None), ("a", ""), ("c", "one")], "id string, text string"), "one", 3, id_col="id"))
    index.change(None, spark.createDataFrame([("b", None), ("a", ""), ("c", "one")], "id string, text string"))
    assert index.search("one", 3).isEmpty() and index.documents().isEmpty()
    with pytest.raises(ValueError):
        index.search("x", 0)


def shuffled(spark):
    """How many rows all stages of the session have shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("make", ["sparse", "lexical"])
def test_postings_are_shuffled_by_the_group(spark, tmp_path, make):
    """Not one by one: 40,000 of them here, of 20 terms."""
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(20))) for i in range(2000)], "id long, text string").coalesce(2)
    before = shuffled(spark)
    if make == "sparse":
        index = SparseIndex(spark, str(tmp_path / "i"))
        index.change(docs, None)
        index.change(None, docs.where("id < 1000"))
        there = docs.where("id >= 1000")
    else:
        index, there = lexical.LexicalIndex.create(docs, str(tmp_path / "i"), id_col="id"), docs
    assert shuffled(spark) - before < 4000
    assert pairs(index.search("w3 w4", 5)) == pairs(lexical.bm25(there, "w3 w4", 5, id_col="id"))


def test_tokens_of_any_text(spark, tmp_path, monkeypatch):
    """Texts are cut as a scan cuts them, also where groups end because they have many tokens."""
    texts = ["Kelvin İx straße ÀB1c", "", None, "kelvin KELVIN\x00x x", "é" * 9, "i x ss ab b1c i"] * 5
    docs = spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    monkeypatch.setattr(lexical, "_MOST", 5)
    assert lexical.inverted(docs, 1000).select("part").distinct().count() > 5
    kept = SparseIndex(spark, str(tmp_path / "s"), group=4)
    kept.change(docs, None)
    once = lexical.LexicalIndex.create(docs, str(tmp_path / "l"), id_col="id")
    for query in ("kelvin", "x i", "b1c stra e", "Àb1c"):
        want = pairs(lexical.bm25(docs, query, 12, id_col="id"))
        assert pairs(kept.search(query, 12)) == want and pairs(once.search(query, 12)) == want, query
