"""Embedders and rerankers: protocols, offline stand-ins and optional adapters."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short names of published models.
PRESETS = {
    "minilm": {"id": "sentence-transformers/all-MiniLM-L6-v2", "prefix": "", "dim": 384},
    "bge-m3": {"id": "BAAI/bge-m3", "prefix": "", "dim": 1024},
}
DEFAULT_MODEL = "bge-m3"
DEFAULT_RERANKER = "cross-encoder/ms-marco-MiniLM-L-6-v2"


class Embedder(Protocol):
    """Pickles cheaply; loads what it needs when it first encodes, on the executor."""

    model_id: str
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class ModelChoice:
    model_id: str
    prefix: str = ""
    query_prefix: str | None = None
    dim: int | None = None


def resolve(name: str | None = None) -> ModelChoice:
    """A preset's model, or the name itself as a model's id; by default SIFTLIGHT_MODEL
    from the environment."""
    name = name or os.environ.get("SIFTLIGHT_MODEL") or DEFAULT_MODEL
    found = PRESETS.get(name)
    return ModelChoice(found["id"], found["prefix"], None, found["dim"]) if found else ModelChoice(name)


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashes of tokens in ``dim`` buckets, at length one. Deterministic and
    offline; it knows shared words, not meanings. A text without tokens is zero."""

    dim: int = 256
    prefix: str = ""

    @property
    def model_id(self) -> str:
        return f"hashing-{self.dim}"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for token in re.findall("[a-z0-9]+", (self.prefix + text).lower()):
                h = zlib.crc32(token.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class SentenceEmbedder:
    """A sentence-transformers model, from the local cache first. Needs that library."""

    def __init__(self, choice: ModelChoice):
        self.choice, self.model_id, self.dim = choice, choice.model_id, choice.dim or 0
        self._model = None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            try:
                self._model = SentenceTransformer(self.model_id, local_files_only=True)
            except OSError:
                self._model = SentenceTransformer(self.model_id)
        return self._model.encode([self.choice.prefix + t for t in texts], normalize_embeddings=True)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with the text's vector; an executor's worker loads the model once."""
    names = [c for c in df.columns if c != into]

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embedder.encode([t or "" for t in part.column(names.index(text)).to_pylist()])
                values = pa.array(list(np.asarray(vectors, dtype=np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*names, into])

    kept = df.select(*names)
    full = T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])
    return kept.mapInArrow(run, full)


@dataclass(frozen=True)
class OverlapScorer:
    """Stands in for a cross-encoder: the share of the query's tokens that a text has."""

    def score(self, query: str, texts: Sequence[str]) -> np.ndarray:
        asked = set(re.findall("[a-z0-9]+", query.lower()))
        return np.array([len(asked & set(re.findall("[a-z0-9]+", t.lower()))) / max(1, len(asked)) for t in texts])


class CrossEncoderScorer:
    """A sentence-transformers cross-encoder. Needs that library."""

    def __init__(self, model_id: str = DEFAULT_RERANKER):
        self.model_id, self._model = model_id, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def score(self, query: str, texts: Sequence[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import CrossEncoder

            self._model = CrossEncoder(self.model_id)
        return np.asarray(self._model.predict([(query, t) for t in texts]))


def rerank(shortlist: DataFrame, query: str, scorer: PairScorer, k: int) -> DataFrame:
    """The k best (id, text) of a shortlist by the scorer, with score and rank. The
    shortlist is limited before this is called."""
    from siftlight.operators.lexical import top

    kind = shortlist.schema["id"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            scores = scorer.score(query, [t or "" for t in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.asarray(scores, dtype=np.float64))], names=["id", "score"])

    scored = shortlist.select("id", F.col("text")).mapInArrow(run, f"id {kind}, score double")
    return top(scored, k)
