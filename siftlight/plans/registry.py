"""Queries over the test tables, and the SQL that each is held against where SQL can say it.

Every query reads its whole tables. A limit is there only where it is the operator: the
best k of a ranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions import stats, text, vectors
from siftlight.functions.stop_words import ENGLISH
from siftlight.operators import chunk, cluster, dense, embed, fusion, graph_index, latent, lexical, neighbours, project, search, sparse_index
from siftlight.sources import files, markdown, store, tables

#: What the queries ask for. The vector is a sum of stored ones, so that none is the query itself.
ASKED = "the version of that license is and thati"
PARTS = (3, 17, 141)
K, POOL = 10, 50

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return tables.spread(_table(spark, sf_dir, "documents"))


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings")


def _asked_vector(spark, sf_dir) -> list[float]:
    rows = _vectors(spark, sf_dir).where(F.col("vec_id").isin(list(PARTS))).select("embedding").collect()
    return [sum(x) for x in zip(*(r["embedding"] for r in rows))]


_made: dict[tuple[str, str, str], str] = {}


def _once(spark, sf_dir: str, name: str, make: Callable[[str], object]) -> str:
    """Where ``make`` has written ``name`` for these tables, once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        root = f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make(root)
        _made[key] = root
    return _made[key]


_ASKED_SQL = f"""
asked AS (SELECT list(s ORDER BY i) AS v FROM (
  SELECT i, sum(CAST(embedding[i] AS DOUBLE)) AS s FROM embeddings, range(1, 65) r(i) WHERE vec_id IN {PARTS} GROUP BY i)),
cosines AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e,
  round(list_dot_product(embedding::DOUBLE[], v)
    / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS score
  FROM embeddings, asked)"""



def _bm25_sql(source: str) -> str:
    return f"""
cut AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {source}),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM cut),
dfs AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(t)) AS term FROM cut) GROUP BY term),
idfs AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, sizes),
mean AS (SELECT avg(idf) AS m FROM idfs),
wanted(term, times) AS (VALUES {", ".join(f"('{w}', {ASKED.split().count(w)})" for w in dict.fromkeys(ASKED.split()))}),
weights AS (SELECT term, times, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS w FROM wanted JOIN idfs USING (term), mean),
hits AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM cut) WHERE term IN (SELECT term FROM wanted) GROUP BY id, term),
sums AS (SELECT id, sum(times * w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s FROM hits JOIN weights USING (term), sizes GROUP BY id),
bm25 AS (SELECT cut.id, round(coalesce(s, 0.0), 6) + 0.0 AS score FROM cut LEFT JOIN sums USING (id))"""


_BM25_SQL = _bm25_sql("documents")


def _ranked_sql(source: str, k: int, columns: str = "id, score") -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {source} ORDER BY score DESC, id LIMIT {k}"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval."""
    return rrf_fusion(spark, sf_dir)


# --- text -----------------------------------------------------------------------------


@_query(
    """SELECT doc_id, CASE WHEN norm = '' THEN 0 ELSE len(string_split(regexp_replace(norm, '([.!?])\\s+(["''(\\[]?[A-Z0-9])',
    '\\1' || chr(1) || '\\2', 'g'), chr(1))) END::INTEGER AS sentences
    FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm FROM documents)"""
)
def sentence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


@_query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def collapse_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.collapse(F.col("text")).alias("flat"))


def _chunk_sql(limit: int, overlap: int) -> str:
    """Chunks by folds over lists: words of long sentences into pieces, then units into chunks."""
    word = f"""lambda x, y: CASE
      WHEN length(y.cur) > {limit} THEN {{'done': list_concat(x.done, CASE WHEN x.cur = '' THEN []::VARCHAR[] ELSE [x.cur] END,
        list_transform(range(0, length(y.cur), {limit}), lambda i: substr(y.cur, i + 1, {limit}))), 'cur': ''}}
      WHEN x.cur = '' THEN {{'done': x.done, 'cur': y.cur}}
      WHEN length(x.cur) + 1 + length(y.cur) > {limit} THEN {{'done': list_append(x.done, x.cur), 'cur': y.cur}}
      ELSE {{'done': x.done, 'cur': x.cur || ' ' || y.cur}} END"""
    tail = f"x.cur[list_min(list_filter(range(1, len(x.cur) + 1), lambda b: b = len(x.cur) OR length(array_to_string(x.cur[b:], ' ')) <= {overlap})):]"
    unit = f"""lambda x, y: CASE WHEN len(x.cur) > 0 AND length(array_to_string(x.cur, ' ')) + 1 + length(y.cur[1]) > {limit}
      THEN {{'done': list_append(x.done, array_to_string(x.cur, ' ')), 'cur': list_concat({tail}, y.cur)}}
      ELSE {{'done': x.done, 'cur': list_concat(x.cur, y.cur)}} END"""
    return f"""flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents),
    parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(f,
      '([.!?])\\s+(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM flat WHERE f <> '')),
    split AS (SELECT doc_id, i, CASE WHEN length(s) > {limit} THEN list_reduce(list_transform(string_split(s, ' '),
      lambda w: {{'done': []::VARCHAR[], 'cur': w}}), {word}, {{'done': []::VARCHAR[], 'cur': ''}}) ELSE {{'done': [s], 'cur': ''}} END AS r FROM parts),
    units AS (SELECT doc_id, flatten(list(CASE WHEN r.cur = '' THEN r.done ELSE list_append(r.done, r.cur) END ORDER BY i)) AS u FROM split GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(list_transform(u, lambda v: {{'done': []::VARCHAR[], 'cur': [v]}}), {unit},
      {{'done': []::VARCHAR[], 'cur': []::VARCHAR[]}}) AS r FROM units),
    listed AS (SELECT doc_id, list_append(r.done, array_to_string(r.cur, ' ')) AS c FROM folded),
    chunks AS (SELECT doc_id, (generate_subscripts(c, 1) - 1)::INTEGER AS ordinal, unnest(c) AS text FROM listed)"""


@_query(f"WITH {_chunk_sql(chunk.MAX_CHARS, chunk.OVERLAP)} SELECT doc_id, ordinal, text FROM chunks")
def chunk_text(spark, sf_dir):
    return chunk.chunk(_docs(spark, sf_dir), "doc_id")


@_query(
    f"""WITH {_chunk_sql(chunk.MAX_CHARS, chunk.OVERLAP)} SELECT count(*) AS chunks, count(DISTINCT text) AS distinct_texts, max(length(text))::INTEGER AS longest,
    count(*) FILTER (WHERE length(text) > {chunk.MAX_CHARS}) AS over FROM chunks"""
)
def chunk_stats(spark, sf_dir):
    rows = chunk.chunk(_docs(spark, sf_dir), "doc_id")
    return rows.agg(
        F.count("*").alias("chunks"), F.countDistinct("text").alias("distinct_texts"), F.max(F.length("text")).alias("longest"),
        F.count_if(F.length("text") > chunk.MAX_CHARS).alias("over"),
    )


@_query(
    "SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents) GROUP BY term"
)
def tokenize_df(spark, sf_dir):
    terms = _docs(spark, sf_dir).select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


@_query("SELECT doc_id, sha256('model' || chr(0) || text) AS chunk_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.content_hash(F.col("text"), "model").alias("chunk_hash"))


@_query(
    "SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 160) || CASE WHEN length(text) > 160 THEN '...' ELSE '' END AS preview FROM documents"
)
def preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


@_query(
    """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda v: v <> '') AS w FROM documents),
    r AS (SELECT doc_id, list_reduce(list_transform(w, lambda v: {'line': v, 'done': []::VARCHAR[]}), lambda x, y: CASE
      WHEN length(x.line) + length(y.line) + 1 > 60 THEN {'line': y.line, 'done': list_append(x.done, x.line)}
      WHEN x.line = '' THEN {'line': y.line, 'done': x.done} ELSE {'line': x.line || ' ' || y.line, 'done': x.done} END, {'line': '', 'done': []::VARCHAR[]}) AS r FROM w)
    SELECT doc_id, array_to_string(list_append(r.done, r.line), '<br>') AS wrapped FROM r"""
)
def wrap_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.wrap(F.col("text")).alias("wrapped"))


# --- vectors --------------------------------------------------------------------------


@_query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@_query(
    """SELECT vec_id, '[' || list_aggregate(list_transform(embedding[1:8], lambda x: printf('%+.4f', x::DOUBLE)), 'string_agg', ', ')
    || printf(', ...] (norm %.4f)', sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS shown FROM embeddings"""
)
def vector_preview(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", vectors.preview(F.col("embedding")).alias("shown"))


@_query(f"WITH {_ASKED_SQL} {_ranked_sql('cosines', K)}")
def dense_topk(spark, sf_dir):
    return dense.exact(_vectors(spark, sf_dir), _asked_vector(spark, sf_dir), K)


@_query(
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
      * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
    SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {K}"""
)
def dense_topk_many(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.exact_many(rows, asked, K)


@_query()
def ann_ivf(spark, sf_dir):
    """Every row whose id is divisible by 100 asks all rows, through an index that is written once."""
    rows = _vectors(spark, sf_dir)
    root = _once(spark, sf_dir, "ivf", lambda where: dense.IvfIndex.create(rows, where))
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.IvfIndex.read(spark, root).search_many(asked, K)


def _graph(spark, sf_dir) -> graph_index.GraphIndex:
    root = _once(spark, sf_dir, "graph", lambda where: graph_index.GraphIndex.create(_vectors(spark, sf_dir), where))
    return graph_index.GraphIndex.read(spark, root)


def _hundredth(rows):
    return rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@_query()
def ann_graph(spark, sf_dir):
    """The same by walks over proximity graphs."""
    return _graph(spark, sf_dir).search_many(_hundredth(_vectors(spark, sf_dir)), K).withColumn("rank", F.col("rank").cast("long"))


@_query()
def ann_graph_where(spark, sf_dir):
    """The same among the rows of some labels."""
    found = _graph(spark, sf_dir).where("label IN (1, 5, 8)").search_many(_hundredth(_vectors(spark, sf_dir)), K)
    return found.withColumn("rank", F.col("rank").cast("long"))


# --- lexical --------------------------------------------------------------------------


@_query(f"WITH {_BM25_SQL} {_ranked_sql('bm25', K)}")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(_docs(spark, sf_dir), ASKED, K)


@_query(f"WITH {_BM25_SQL} SELECT id, score FROM bm25")
def bm25_scores(spark, sf_dir):
    scores = lexical.bm25_scores(_docs(spark, sf_dir), ASKED)
    return scores.select("id", (F.round("score", 6) + 0.0).alias("score"))


@_query(f"WITH {_BM25_SQL} {_ranked_sql('bm25', K)}")
def bm25_index_topk(spark, sf_dir):
    root = _once(spark, sf_dir, "bm25", lambda where: lexical.LexicalIndex.create(_docs(spark, sf_dir), where))
    return lexical.LexicalIndex.read(spark, root).search(ASKED, K)


@_query(f"WITH {_bm25_sql('(SELECT * FROM documents WHERE doc_id % 3 <> 1)')} {_ranked_sql('bm25', K)}")
def sparse_index_topk(spark, sf_dir):
    """An index to which two thirds of the documents come, then another third while one goes."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")

    def make(where: str) -> None:
        index = sparse_index.SparseIndex(spark, where)
        index.change(docs.where(F.col("id") % 3 != 0), None)
        index.change(docs.where(F.col("id") % 3 == 0), docs.where(F.col("id") % 3 == 1))

    return sparse_index.SparseIndex(spark, _once(spark, sf_dir, "sparse", make)).search(ASKED, K)


def _tfidf_sql() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    return f"""WITH words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
    tfs AS (SELECT id, term, count(*) AS tf FROM words WHERE term NOT IN ({stops}) GROUP BY id, term),
    total AS (SELECT count(*) AS n FROM documents),
    idfs AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tfs, total GROUP BY term, n),
    asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{ASKED}', '[a-z0-9_]{{2,}}')) AS term) WHERE term NOT IN ({stops}) GROUP BY term),
    q AS (SELECT term, times * idf AS w FROM asked JOIN idfs USING (term)),
    qn AS (SELECT sqrt(sum(w * w)) AS qn FROM q),
    d AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS dn, sum(tf * idf * coalesce(w, 0)) AS dot FROM tfs JOIN idfs USING (term) LEFT JOIN q USING (term) GROUP BY id),
    scored AS (SELECT doc_id AS id, round(coalesce(CASE WHEN dot > 0 THEN dot / (dn * qn) END, 0.0), 6) AS score FROM documents LEFT JOIN (SELECT * FROM d, qn) x ON doc_id = x.id)
    {_ranked_sql("scored", K)}"""


@_query(_tfidf_sql())
def tfidf_topk(spark, sf_dir):
    return lexical.tfidf(_docs(spark, sf_dir), ASKED, K)


# --- the search entry -----------------------------------------------------------------


@dataclass(frozen=True)
class _Given:
    """Stands for a model: whatever the text, it gives one vector."""

    vector: tuple[float, ...]
    model_id: str = "given"

    @property
    def dim(self) -> int:
        return len(self.vector)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([self.vector] * len(texts))


def _searcher(spark, sf_dir) -> search.Searcher:
    """Documents with the vectors of their ids; many have none."""
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.Searcher(_docs(spark, sf_dir), _Given(tuple(_asked_vector(spark, sf_dir))), "doc_id", vectors=vectors)


#: Scores of all documents: those without a vector have zero.
_NEAR_SQL = "near AS (SELECT doc_id AS id, coalesce(score, 0.0::DOUBLE) AS score FROM documents LEFT JOIN cosines ON id = doc_id)"


def _shown_sql(ranked: str, source: str = "documents") -> str:
    return f"SELECT rank, r.id, text, source, score FROM ({ranked}) r JOIN {source} d ON d.doc_id = r.id"


@_query(
    f"""WITH {_ASKED_SQL}, {_NEAR_SQL}, {_BM25_SQL}, a AS ({_ranked_sql('near', POOL)}), b AS ({_ranked_sql('bm25', POOL)}),
    f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT id, rank FROM a UNION ALL SELECT id, rank FROM b) GROUP BY id)
    {_shown_sql(_ranked_sql('f', K))}"""
)
def search_hybrid(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "hybrid", K, POOL)


@_query(f"WITH {_bm25_sql('(SELECT * FROM documents WHERE lang = $$de$$)')} {_shown_sql(_ranked_sql('bm25', K))}")
def search_where(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "lexical", K, where="lang = 'de'")


@_query(f"WITH {_ASKED_SQL}, {_NEAR_SQL} {_shown_sql(_ranked_sql('near', K))}")
def search_dense(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "dense", K)


# --- fusion ---------------------------------------------------------------------------


_LISTS_SQL = f"""WITH {_ASKED_SQL}, {_BM25_SQL},
a AS ({_ranked_sql('cosines', POOL)}), b AS ({_ranked_sql('bm25', POOL)})"""


def _lists(spark, sf_dir):
    return (
        dense.exact(_vectors(spark, sf_dir), _asked_vector(spark, sf_dir), POOL),
        lexical.bm25(_docs(spark, sf_dir), ASKED, POOL),
    )


@_query(
    f"""{_LISTS_SQL}, f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT id, rank FROM a UNION ALL SELECT id, rank FROM b) GROUP BY id)
    {_ranked_sql('f', K)}"""
)
def rrf_fusion(spark, sf_dir):
    return fusion.reciprocal_rank(list(_lists(spark, sf_dir)), K)


_MINMAX = "CASE WHEN max(score) OVER () = min(score) OVER () THEN 0.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END"


@_query(
    f"""{_LISTS_SQL}, x AS (SELECT id, {_MINMAX} AS s FROM a), y AS (SELECT id, {_MINMAX} AS s FROM b),
    f AS (SELECT id, round(0.5::DOUBLE * coalesce(x.s, 0) + 0.5::DOUBLE * coalesce(y.s, 0), 6) AS score FROM x FULL JOIN y USING (id))
    {_ranked_sql('f', K)}"""
)
def weighted_fusion(spark, sf_dir):
    return fusion.weighted(*_lists(spark, sf_dir), K)


@_query(f"WITH {_ASKED_SQL} SELECT id, round({_MINMAX}, 9) AS score FROM cosines")
def minmax_scores(spark, sf_dir):
    scores = dense.cosine_scores(_vectors(spark, sf_dir), _asked_vector(spark, sf_dir))
    scaled = fusion.minmax(scores.withColumn("score", F.round("score", 6)))
    return scaled.select("id", F.round("score", 9).alias("score"))


def _mmr_sql(k: int, source: str = "cosines") -> str:
    """A step of picking is a query over the picks before."""
    steps = ["p1 AS (SELECT id, score, e, 1 AS rank FROM pool ORDER BY score DESC, id LIMIT 1)"]
    for i in range(2, k + 1):
        steps.append(
            f"""g{i} AS (SELECT o.id, any_value(o.score) AS score, any_value(o.e) AS e,
            round(0.5::DOUBLE * any_value(o.score) - 0.5::DOUBLE * max(list_dot_product(o.e, p.e)), 12) AS gain
            FROM pool o, p{i - 1} p WHERE o.id NOT IN (SELECT id FROM p{i - 1}) GROUP BY o.id),
            p{i} AS (SELECT id, score, e, rank FROM p{i - 1} UNION ALL
            (SELECT id, score, e, {i} FROM g{i} ORDER BY gain DESC, score DESC, id LIMIT 1))"""
        )
    return f"WITH {_ASKED_SQL}, pool AS (SELECT id, score, e FROM {source} ORDER BY score DESC, id LIMIT {POOL}), {', '.join(steps)} SELECT id, score, rank::BIGINT AS rank FROM p{k}"


@_query(_mmr_sql(5))
def mmr_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    near = dense.exact(rows, _asked_vector(spark, sf_dir), POOL)
    pool = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(F.broadcast(near), "id")
    return fusion.mmr(pool.select("id", "score", "vector"), 5)


@_query(_shown_sql(_mmr_sql(5, "(SELECT * FROM cosines WHERE id IN (SELECT doc_id FROM documents))")))
def search_mmr(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "mmr", 5, POOL)


@_query(
    f"""WITH {_ASKED_SQL}, {_NEAR_SQL}, {_BM25_SQL}, a AS ({_ranked_sql('near', POOL)}), b AS ({_ranked_sql('bm25', POOL)}),
    x AS (SELECT id, {_MINMAX} AS s FROM a), y AS (SELECT id, {_MINMAX} AS s FROM b),
    f AS (SELECT id, round(0.5::DOUBLE * coalesce(x.s, 0) + 0.5::DOUBLE * coalesce(y.s, 0), 6) AS score FROM x FULL JOIN y USING (id))
    {_shown_sql(_ranked_sql('f', K))}"""
)
def search_weighted(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "weighted", K, POOL)


@_query(_shown_sql(_tfidf_sql()))
def search_tfidf(spark, sf_dir):
    return _searcher(spark, sf_dir).search(ASKED, "tfidf", K)


_TERMS = len(set(ASKED.split()))


@_query(
    f"""WITH {_BM25_SQL}, short AS ({_ranked_sql('bm25', POOL)}),
    f AS (SELECT short.id, round((SELECT count(*) FROM wanted WHERE list_contains(cut.t, wanted.term)) / {_TERMS}.0::DOUBLE, 6) AS score
      FROM short JOIN cut ON short.id = cut.id) {_ranked_sql('f', K)}"""
)
def rerank_topk(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    short = lexical.bm25(docs, ASKED, POOL)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(short), "id")
    return embed.rerank(texts.select("id", "text"), ASKED, embed.OverlapScorer(), K)


# --- the table ------------------------------------------------------------------------


@_query("SELECT sha256('model' || chr(0) || text) AS chunk_hash, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", text.content_hash(F.col("text"), "model").alias("chunk_hash"))
    return rows.groupBy("chunk_hash").agg(F.min("doc_id").alias("doc_id"))


@_query(
    """WITH held AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 0), wanted AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 1)
    SELECT (SELECT count(*) FROM wanted WHERE text NOT IN (SELECT text FROM held)) AS fresh, (SELECT count(*) FROM wanted WHERE text IN (SELECT text FROM held)) AS hits,
    (SELECT count(*) FROM held WHERE text NOT IN (SELECT text FROM wanted)) AS stale"""
)
def ingest_diff(spark, sf_dir):
    """Two thirds of the documents against another two: what an ingest would embed, keep and drop."""
    docs = _docs(spark, sf_dir)
    held = store.hashed(docs.where(F.col("doc_id") % 3 != 0), "model")
    wanted = store.hashed(docs.where(F.col("doc_id") % 3 != 1), "model")
    parts = store.difference(wanted, held)
    counts = [p.agg(F.count("*").alias(n)) for p, n in zip(parts, ("fresh", "hits", "stale"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@_query("SELECT count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(*) AS n FROM documents")
def source_counts(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.countDistinct("source").alias("sources"), F.countDistinct("text").alias("texts"), F.count("*").alias("n"))


@_query()
def hashing_embeddings(spark, sf_dir):
    rows = embed.embed(_docs(spark, sf_dir).select("doc_id", "text"), embed.HashingEmbedder(64))
    digest = F.sha2(F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double") + 0.0)), ",").cast("binary"), 256)
    return rows.select("doc_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"), digest.alias("digest"))


def _latent(spark, sf_dir) -> DataFrame:
    """Documents with vectors along directions that are learned from all of them, written once."""
    docs = _docs(spark, sf_dir)

    def make(where: str) -> None:
        model, vectors = latent.fit_embed(docs, 64)
        model.save(spark, f"{where}/model")
        vectors.withColumnRenamed("id", "doc_id").write.parquet(f"{where}/vectors")

    return spark.read.parquet(f"{_once(spark, sf_dir, 'latent', make)}/vectors")


@_query()
def latent_embeddings(spark, sf_dir):
    return _latent(spark, sf_dir).select("doc_id", "embedding")


@_query()
def latent_search(spark, sf_dir):
    """Every document whose id is divisible by 100 asks all documents for what is about the same."""
    rows = _latent(spark, sf_dir)
    asked = rows.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.exact_many(rows, asked, K, "doc_id")


@_query(
    """WITH l AS (SELECT text, arg_max(label, doc_id) AS cluster FROM (SELECT d.doc_id, d.text, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id) GROUP BY text)
    SELECT doc_id, l.cluster AS cluster FROM documents LEFT JOIN l USING (text)"""
)
def attach_labels(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    labelled = docs.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")), "doc_id")
    return cluster.attach_labels(docs.select("doc_id", "text"), labelled.select("doc_id", "text", "cluster"), id_col="doc_id").select("doc_id", "cluster")


_LABELS_SQL = """l AS (SELECT text, arg_max(label, doc_id) AS cluster FROM (SELECT d.doc_id, d.text, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id) GROUP BY text)"""


@_query(f"WITH {_LABELS_SQL} SELECT count(*) AS entries, count(*) FILTER (WHERE l.text IS NULL) AS missed FROM documents LEFT JOIN l USING (text)")
def label_misses(spark, sf_dir):
    """The entries of a file of labels, read back, and how many have none."""
    docs = _docs(spark, sf_dir)
    labelled = docs.join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")), "doc_id")
    path = f"{tables.shared_dir(spark)}/labels-{uuid.uuid4().hex}"
    counts = cluster.write_labelled(docs.select("doc_id", "text"), labelled.select("doc_id", "text", "cluster"), path, id_col="doc_id")
    return spark.createDataFrame([counts], "entries long, missed long")


@_query(
    """WITH held AS (SELECT text, min(source) AS source FROM documents WHERE doc_id % 3 <> 0 GROUP BY text),
    wanted AS (SELECT text, min(source) AS source FROM documents WHERE doc_id % 3 <> 1 GROUP BY text)
    SELECT sha256('hashing-16' || chr(0) || w.text) AS chunk_hash, w.text, coalesce(h.source, w.source) AS source, 16::INTEGER AS dim
    FROM wanted w LEFT JOIN held h ON w.text = h.text"""
)
def store_round_trip(spark, sf_dir):
    """Two ingests into a table, the second of which adds some texts and drops others; then all of it."""
    docs, embedder = _docs(spark, sf_dir), embed.HashingEmbedder(16)
    table = store.Store(spark, f"{tables.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    table.ingest(docs.where(F.col("doc_id") % 3 != 0), embedder)
    table.ingest(docs.where(F.col("doc_id") % 3 != 1), embedder)
    table.verify()
    return table.read().select("chunk_hash", "text", "source", F.size("embedding").alias("dim"))


# --- sources --------------------------------------------------------------------------

_STATE = "{'line': '', 'q': false, 'c': false, 'docs': []::VARCHAR[], 'query': NULL::VARCHAR}"


def _state(**changed: str) -> str:
    old = {"line": "''", "q": "x.q", "c": "x.c", "docs": "x.docs", "query": "x.query"} | changed
    return "{" + ", ".join(f"'{k}': {v}" for k, v in old.items()) + "}"


@_query(
    f"""WITH lines AS (SELECT doc_id, list_transform(string_split('<!-- ' || source || chr(10) || '- hidden -->' || chr(10) || '# Documents' || chr(10) || '- ' || text
      || chr(10) || '## Queries' || chr(10) || '1. ' || source || chr(10) || 'second', chr(10)),
      lambda l: {{'line': regexp_replace(l, '^\\s+|\\s+$', '', 'g'), 'q': false, 'c': false, 'docs': []::VARCHAR[], 'query': NULL::VARCHAR}}) AS l FROM documents),
    folded AS (SELECT doc_id, list_reduce(l, lambda x, y: CASE
      WHEN x.c THEN {_state(c="NOT contains(y.line, '-->')")}
      WHEN starts_with(y.line, '<!--') THEN {_state(c="NOT contains(y.line, '-->')")}
      WHEN starts_with(y.line, '#') THEN {_state(q="starts_with(lower(regexp_replace(y.line, '^#+ *', '')), 'quer')")}
      WHEN y.line = '' THEN {_state()}
      WHEN NOT x.q THEN {_state(docs="list_append(x.docs, trim(regexp_replace(y.line, '^([-*+] |[0-9]+[.] )', '')))")}
      ELSE {_state(query="coalesce(x.query, trim(regexp_replace(y.line, '^([-*+] |[0-9]+[.] )', '')))")} END, {_STATE}) AS r FROM lines)
    SELECT doc_id, 'document' AS kind, (generate_subscripts(r.docs, 1) - 1)::BIGINT AS ordinal, unnest(r.docs) AS text FROM folded
    UNION ALL SELECT doc_id, 'query', 0::BIGINT, r.query FROM folded WHERE r.query IS NOT NULL"""
)
def markdown_parse(spark, sf_dir):
    """Each document as a markdown file with a comment, documents and queries."""
    page = F.concat(
        F.lit("<!-- "), "source", F.lit("\n- hidden -->\n# Documents\n- "), "text", F.lit("\n## Queries\n1. "), "source", F.lit("\nsecond")
    )
    return markdown.parse_texts(_docs(spark, sf_dir).select("doc_id", page.alias("value")), "doc_id")


@_query(
    """SELECT doc_id || '.txt' AS source, text FROM documents UNION ALL
    SELECT doc_id || '.fb2', 'Head ' || source || chr(10) || 'A — ' || lang || ' line' || chr(10) || 'bare' FROM documents"""
)
def file_texts(spark, sf_dir):
    """Documents as plain files, and as books with nested blocks, entities, bare text and a binary part."""
    docs = _docs(spark, sf_dir)
    book = F.concat(
        F.lit("<FictionBook><description>no</description><body><title><p>Head  "), "source", F.lit("</p></title><section><p>A &mdash; "), "lang",
        F.lit(" <b>line</b></p>bare</section></body><binary>QUJD</binary></FictionBook>"),
    )
    plain = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), F.col("text").cast("binary").alias("content"))
    books = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".fb2")).alias("source"), book.cast("binary").alias("content"))
    return files.extract_texts(files.extract_pages(plain.unionByName(books)))


# --- clusters -------------------------------------------------------------------------


@_query("SELECT r.k::INTEGER AS cluster, count(vec_id) AS n FROM range(12) r(k) LEFT JOIN embeddings ON label = r.k GROUP BY r.k")
def cluster_sizes(spark, sf_dir):
    return cluster.sizes(_vectors(spark, sf_dir), 12, "label")


@_query(
    """WITH m AS (SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM (
      SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 10 GROUP BY label),
    s AS (SELECT r.k::INTEGER AS cluster, count(vec_id) AS n FROM range(12) r(k) LEFT JOIN embeddings ON label = r.k GROUP BY r.k)
    SELECT cluster, n, coalesce(members, '') AS members FROM s LEFT JOIN m ON cluster = label"""
)
def cluster_members(spark, sf_dir):
    found = cluster.members(_vectors(spark, sf_dir), 12, label="label", id_col="vec_id")
    return found.select("cluster", "n", F.coalesce(F.array_join(F.col("first_members").cast("array<string>"), ","), F.lit("")).alias("members"))


@_query(
    """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(1 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))) AS s,
      count(*) FILTER (WHERE a.vec_id <> b.vec_id) AS n FROM u a, u b GROUP BY a.vec_id, a.label, b.label),
    p AS (SELECT vec_id, max(CASE WHEN own = other AND n > 0 THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p"""
)
def silhouette(spark, sf_dir):
    value = cluster.silhouette(_vectors(spark, sf_dir), label="label")
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@_query()
def kmeans_clusters(spark, sf_dir):
    found = cluster.kmeans(_vectors(spark, sf_dir), 10)
    return found.select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@_query()
def kmeans_sweep(spark, sf_dir):
    """All k from 2 to 20, with all starts, over all rows."""
    return cluster.sweep(_vectors(spark, sf_dir), sample=0, id_col="vec_id")


@_query()
def pca_projection(spark, sf_dir):
    return project.pca(_vectors(spark, sf_dir), "vec_id")


@_query()
def knn_graph(spark, sf_dir):
    """The nearest neighbours of every row, by NN-descent."""
    return neighbours.graph(_vectors(spark, sf_dir), K)


@_query()
def umap_projection(spark, sf_dir):
    return project.umap(_vectors(spark, sf_dir), "vec_id")


@_query()
def subsample(spark, sf_dir):
    return cluster.subsample(_vectors(spark, sf_dir), 100, "vec_id").select("vec_id")


# --- measurements ---------------------------------------------------------------------


@_query(
    """SELECT quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem"""
)
def nearest_rank_pct(spark, sf_dir):
    return stats.percentiles(_table(spark, sf_dir, "lineitem"), "l_extendedprice", (50, 95, 99))


@_query(
    """SELECT min(value) AS best, min(CASE WHEN event_id < 10 THEN value END) AS best_of_10, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50,
    quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events"""
)
def latency_stats(spark, sf_dir):
    found = stats.latency_stats(_table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.col("value").alias("ms")))
    return found.withColumn("mean", F.round("mean", 6))


@_query(
    """WITH d AS (SELECT max(len(embedding)) * 4 AS size, count(*) AS own FROM embeddings), n AS (SELECT unnest([1000, 1000000, own]) AS n, size FROM d), b AS (SELECT n, n * size AS bytes FROM n)
    SELECT n::BIGINT AS vectors, bytes::BIGINT AS bytes, CASE WHEN bytes < 1048576 THEN format('{:,} B ({:.2f} KiB)', bytes::BIGINT, bytes / 1024.0::DOUBLE)
    WHEN bytes < 1073741824 THEN format('{:,} B ({:.2f} MiB)', bytes::BIGINT, bytes / 1048576.0::DOUBLE)
    ELSE format('{:,} B ({:.2f} GiB)', bytes::BIGINT, bytes / 1073741824.0::DOUBLE) END AS shown FROM b"""
)
def storage_projection(spark, sf_dir):
    """What the stored vectors take, and a thousand and a million of their width."""
    found = _vectors(spark, sf_dir).agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n")).first()
    return stats.storage_projection(spark, found["dim"], (1_000, 1_000_000, found["n"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
