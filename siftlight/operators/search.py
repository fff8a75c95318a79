"""One entry for all ways of retrieval over a table of (id, text, embedding[, source])."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.functions.text import preview
from siftlight.operators import dense, fusion, lexical
from siftlight.operators.embed import Embedder, OverlapScorer, PairScorer, rerank
from siftlight.operators.graph_index import GraphIndex
from siftlight.operators.sparse_index import SparseIndex

METHODS = ("dense", "lexical", "tfidf", "hybrid", "weighted", "mmr")
DEFAULT_METHOD, K, CANDIDATES = "hybrid", 5, 50


@dataclass
class Searcher:
    """``table`` has ``id_col``, ``text`` and ``embedding``; other columns come along. If
    ``vectors`` (``id_col``, ``embedding``) are kept apart, a row without one counts as one
    with a null; only ids are joined to them, no texts. With an ``index`` over the same vectors, dense search walks its graphs, or looks into its
    nearest lists only; with a ``sparse`` index over the same texts, BM25 reads that."""

    table: DataFrame
    embedder: Embedder | None = None
    id_col: str = "id"
    index: dense.IvfIndex | GraphIndex | None = None
    sparse: SparseIndex | None = None
    vectors: DataFrame | None = None

    @property
    def _embedded(self) -> DataFrame:
        """(``id_col``, ``embedding``) of every row."""
        if self.vectors is None:
            return self.table.select(self.id_col, "embedding")
        return self.table.select(self.id_col).join(self.vectors.select(self.id_col, "embedding"), self.id_col, "left")

    def _vector(self, query: str):
        if self.embedder is None:
            raise ValueError("this method needs an embedder")
        vector = self.embedder.encode([query])[0]
        dense.check_dim(self.table if self.vectors is None else self.vectors, vector)
        return vector

    def search(
        self, query: str, method: str = DEFAULT_METHOD, k: int = K, candidates: int = CANDIDATES, *, do_rerank: bool = False,
        scorer: PairScorer | None = None, alpha: float = fusion.ALPHA, trade: float = fusion.DIVERSITY, where: str | None = None, ef: int | None = None,
    ) -> DataFrame:
        """(rank, id, text, [source,] score). With reranking a method's first
        ``candidates`` results are scored again and the k best stay. ``where`` is a condition
        in SQL on the table's columns; only rows that meet it take part. ``ef``: how many
        vectors an index has to keep in view, or to look at."""
        if where is not None:
            if isinstance(self.index, dense.IvfIndex):
                raise ValueError("lists are searched whole: a graph index takes conditions")
            index = None if self.index is None else self.index.where(where)
            return Searcher(self.table.where(where), self.embedder, self.id_col, index, vectors=self.vectors).search(
                query, method, k, candidates, do_rerank=do_rerank, scorer=scorer, alpha=alpha, trade=trade, ef=ef
            )
        self._ef = ef
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
        if k < 1 or candidates < 1:
            raise ValueError("k and candidates must be at least 1")
        depth = candidates if do_rerank else k
        found = getattr(self, f"_{method}")(query, depth, candidates, alpha, trade)
        if do_rerank:
            texts = self._with_rows(found).select("id", "text")
            found = rerank(texts, query, scorer or OverlapScorer(), k)
        return self._with_rows(found).orderBy("rank")

    def _with_rows(self, found: DataFrame) -> DataFrame:
        """Joins the rows of a short list. It is broadcast: it has ``candidates`` rows at most."""
        columns = [c for c in ("text", "source") if c in self.table.columns]
        rows = self.table.select(F.col(self.id_col).alias("id"), *columns)
        return rows.join(F.broadcast(found), "id").select("rank", "id", *columns, "score")

    def _dense(self, query, depth, candidates, alpha, trade):
        if self.index is not None:
            return self.index.search(self._vector(query), depth, ef=self._ef)
        return dense.exact(self._embedded, self._vector(query), depth, self.id_col)

    def _lexical(self, query, depth, candidates, alpha, trade):
        if self.sparse is not None:
            return self.sparse.search(query, depth)
        return lexical.bm25(self.table, query, depth, id_col=self.id_col)

    def _tfidf(self, query, depth, candidates, alpha, trade):
        return lexical.tfidf(self.table, query, depth, id_col=self.id_col)

    def _hybrid(self, query, depth, candidates, alpha, trade):
        lists = [self._dense(query, candidates, candidates, 0, 0), self._lexical(query, candidates, candidates, 0, 0)]
        return fusion.reciprocal_rank(lists, depth)

    def _weighted(self, query, depth, candidates, alpha, trade):
        return fusion.weighted(self._dense(query, candidates, candidates, 0, 0), self._lexical(query, candidates, candidates, 0, 0), depth, alpha)

    def _mmr(self, query, depth, candidates, alpha, trade):
        near = self._dense(query, candidates, candidates, 0, 0)
        vectors = self._embedded.select(F.col(self.id_col).alias("id"), F.col("embedding").alias("vector"))
        return fusion.mmr(vectors.join(F.broadcast(near), "id").select("id", "score", "vector"), depth, trade)


def shown(results: DataFrame, width: int = 200) -> DataFrame:
    """Results for display: rank, score, source and the start of the text."""
    columns = [c for c in ("source",) if c in results.columns]
    return results.select("rank", F.format_number("score", 4).alias("score"), *columns, preview(F.col("text"), width).alias("text")).orderBy("rank")
