"""``python -m siftlight``: ingest, load, search, cluster, sweep, visualize, bench, models."""

from __future__ import annotations

import argparse
import importlib.util
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.operators import chunk, cluster, dense, embed, fusion, latent, project, search, sparse_index
from siftlight.operators.graph_index import GraphIndex
from siftlight.plans import measure
from siftlight.sources import files, markdown
from siftlight.sources.store import Store


def embedder_of(name: str | None, store: Store | None = None, texts: DataFrame | None = None, anew: bool = False) -> embed.Embedder:
    """``latent`` or ``latent-N``: learned from the first texts that go into ``store``, and
    kept there; ``hashing`` or ``hashing-N``; else a model of sentence-transformers. Without
    a name the store's own, or the default model, or ``latent`` where that library is absent."""
    name = name or os.environ.get("SIFTLIGHT_MODEL")
    if store is not None and (not name or name.startswith("latent")):
        where = f"{store.root}/_latent"
        path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        there = path.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(path)
        if there and not anew:
            return latent.LatentEmbedder.load(store.spark, where)
        if name or not importlib.util.find_spec("sentence_transformers"):
            if texts is None:
                raise SystemExit(f"{store.root} has no model of its own: name one")
            latent.fit(texts, int((name or "").partition("-")[2] or latent.DIM)).save(store.spark, where)
            return latent.LatentEmbedder.load(store.spark, where)
    if name and name.startswith("hashing"):
        return embed.HashingEmbedder(int(name.partition("-")[2] or 256))
    return embed.SentenceEmbedder(embed.resolve(name))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftlight")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("ingest", help="bring a table up to date with documents")
    add.add_argument("path")
    add.add_argument("--store")
    add.add_argument("--out")
    add.add_argument("--max-chars", type=int, default=chunk.MAX_CHARS)
    add.add_argument("--overlap", type=int, default=chunk.OVERLAP)
    add.add_argument("--reset", action="store_true")
    add.add_argument("--model")
    add = sub.add_parser("load", help="load a markdown file of documents")
    add.add_argument("path")
    add.add_argument("--store", required=True)
    add.add_argument("--full", metavar="DIR", help="also write vectors and a report there")
    add.add_argument("--model")
    add = sub.add_parser("search")
    add.add_argument("query")
    add.add_argument("--store", required=True)
    add.add_argument("--method", choices=search.METHODS, default=search.DEFAULT_METHOD)
    add.add_argument("--model")
    add.add_argument("--k", type=int, default=search.K)
    add.add_argument("--candidates", type=int, default=search.CANDIDATES)
    add.add_argument("--alpha", type=float, default=fusion.ALPHA)
    add.add_argument("--lambda", dest="trade", type=float, default=fusion.DIVERSITY)
    add.add_argument("--rerank", action="store_true")
    add.add_argument("--rerank-model", default=embed.DEFAULT_RERANKER, help="a cross-encoder, or overlap: the offline stand-in")
    add.add_argument("--where", help="a condition on the table's columns, such as cluster = 3")
    add.add_argument("--ef", type=int, help="search an index, which is made where there is none, and keep so many vectors in view")
    add.add_argument("--kept", action="store_true", help="search words in an index that is kept with the table, and brought up to date first")
    add.add_argument("--index", choices=("graph", "ivf"), default="graph", help="of that kind")
    add = sub.add_parser("cluster")
    add.add_argument("--store", required=True)
    add.add_argument("--k", type=int, default=cluster.K)
    add.add_argument("--entries", metavar="JSON", help="entries with a text, to be written with their clusters to --out")
    add.add_argument("--out")
    add = sub.add_parser("sweep")
    add.add_argument("--store", required=True)
    add.add_argument("--min-k", type=int, default=2)
    add.add_argument("--max-k", type=int, default=20)
    add.add_argument("--step", type=int, default=1)
    add.add_argument("--sample", type=int, default=cluster.SAMPLE)
    add = sub.add_parser("visualize")
    add.add_argument("--store", required=True)
    add.add_argument("--out", default="clusters.html")
    add.add_argument("--pca", action="store_true")
    add = sub.add_parser("bench")
    add.add_argument("--store", required=True)
    add.add_argument("--query", required=True)
    add.add_argument("--runs", type=int, default=measure.RUNS)
    add.add_argument("--model")
    sub.add_parser("models")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command; returns what it printed."""
    a = _parser().parse_args(argv)
    if a.command == "models":
        text = "\n".join(f"{name}: {x['id']} ({x['dim']} dimensions)" for name, x in embed.PRESETS.items())
    else:
        spark = spark or SparkSession.builder.appName("siftlight").getOrCreate()
        text = globals()[f"_{a.command}"](spark, a)
    print(text)
    return text


def _ingest(spark, a) -> str:
    try:
        texts, bad = files.read_texts(spark, a.path)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    chunks = files.extract_chunks(texts, a.max_chars, a.overlap).persist()
    lines = [f"skipped {r['source']}: {r['reason']}" for r in bad.collect()]
    try:
        if a.out:
            markdown.write(chunks, a.out, order=("source", "ordinal"))
        if a.store:
            store = Store(spark, a.store)
            done = store.ingest(chunks, embedder_of(a.model, store, chunks, a.reset), a.reset)
            lines.append(f"{done.fresh} embedded, {done.hits} there already, {done.stale} dropped, {done.sources} sources")
        else:
            lines.append(f"{chunks.count()} chunks")
    finally:  # what is held would stand for the folder's files for as long as the session lives
        chunks.unpersist()
    return "\n".join(lines)


def _load(spark, a) -> str:
    rows = markdown.read(spark, a.path).where("kind = 'document'")
    if rows.isEmpty():
        raise SystemExit("the file has no documents")
    store = Store(spark, a.store)
    done = store.ingest(rows.select("text"), embedder_of(a.model, store, rows, True), reset=True)
    if a.full:
        from siftlight.sources.store import dump_vectors

        dump_vectors(store.read(), f"{a.full}/vectors")
        times = {"scan": measure.bench(spark, lambda: measure.run(store.read()), runs=10)}
        spark.createDataFrame([(measure.report(spark, times, store.properties().dim),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.full}/report")
    return f"{done.fresh} documents"


def _search(spark, a) -> str:
    store = Store(spark, a.store)
    needs = a.method not in ("lexical", "tfidf")
    scorer = embed.OverlapScorer() if a.rerank_model == "overlap" else embed.CrossEncoderScorer(a.rerank_model)
    searcher = search.Searcher(store.read(), embedder_of(a.model, store) if needs else None, "chunk_hash", _index(spark, store, a.index) if needs and a.ef else None, sparse_index.refreshed(store) if a.kept else None)
    found = searcher.search(
        a.query, a.method, a.k, a.candidates, do_rerank=a.rerank, scorer=scorer, alpha=a.alpha, trade=a.trade, where=a.where, ef=a.ef
    )
    return "\n".join(f"{r['rank']}. ({r['score']}) {r['text']}" for r in search.shown(found).collect())


def _index(spark, store, kind: str) -> GraphIndex | dense.IvfIndex:
    """The index of the store's last version, made when it is first asked for."""
    where = f"{store.root}/_{kind}-{store.manifest().rows[-1]}-{len(store.manifest().gone)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{'rows' if kind == 'graph' else 'probe'}/_SUCCESS")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if kind == "graph":
        return GraphIndex.read(spark, where, "chunk_hash") if there else GraphIndex.create(store.read(), where, id_col="chunk_hash")
    return dense.IvfIndex.read(spark, where, "chunk_hash") if there else dense.IvfIndex.create(store.read(), where, id_col="chunk_hash")


def _cluster(spark, a) -> str:
    store = Store(spark, a.store)
    store.verify()
    store.store_labels(cluster.kmeans(store.read(), a.k))
    found = cluster.members(store.read(), a.k, text_col="text").orderBy("cluster").collect()
    said = []
    if a.entries and a.out:
        n, missed = cluster.write_labelled(spark.read.json(a.entries), store.read(), a.out)
        said = [f"{n} entries written, {missed} without a cluster"]
    return "\n".join([*said, *(f"cluster {r['cluster']}: {r['n']}" + "".join(f"\n  {m['text']}" for m in r["first_members"] or ()) for r in found)])


def _sweep(spark, a) -> str:
    rows = cluster.sweep(Store(spark, a.store).read(), a.min_k, a.max_k, a.step, sample=a.sample).persist()
    lines = [f"{r['k']:4d} {r['silhouette']:10.4f} {r['inertia']:14.4f} {r['smallest']:6d}" for r in rows.orderBy("k").collect()]
    return "\n".join(["   k silhouette        inertia smallest", *lines, cluster.report(rows)])


def _visualize(spark, a) -> str:
    table = Store(spark, a.store).read()
    if table.where("cluster IS NOT NULL").isEmpty():
        raise SystemExit("the table has no clusters yet")
    points = (project.pca if a.pca else project.umap)(table)
    from siftlight.functions.text import wrap

    with open(a.out, "w", encoding="utf-8") as f:
        project.plot_to(points.join(table.select("id", "cluster", wrap(F.col("text"), mark="\n").alias("text")), "id"), f)
    return a.out


def _bench(spark, a) -> str:
    store = Store(spark, a.store)
    embedder = embedder_of(a.model, store)
    searcher = search.Searcher(store.read(), embedder)
    times = {m: measure.bench(spark, lambda m=m: searcher.search(a.query, m).collect(), runs=a.runs) for m in search.METHODS}
    times["embed one"] = measure.bench(spark, lambda: embedder.encode([a.query]), runs=a.runs)
    texts = [r["text"] for r in store.read().select("text").orderBy("text").limit(max(measure.SIZES)).collect()]
    scaled = {
        "Embedding": measure.embed_scaling(embedder, texts, runs=min(a.runs, measure.SCALING_RUNS)),
        "Insert": measure.insert_scaling(spark, embedder, texts, f"{store.root}/_bench-{uuid.uuid4().hex[:8]}", runs=min(a.runs, measure.INSERT_RUNS)),
    }
    return measure.report(spark, times, store.properties().dim, scaled)
