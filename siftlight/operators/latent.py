"""Embeddings learned from a corpus: latent directions of its TF-IDF matrix.

The directions are the matrix's leading right singular vectors, by randomized subspace
iteration (Halko, Martinsson and Tropp, 2011): executors multiply blocks of documents with a
thin matrix, products are summed by term, and only the thin matrix, whose size follows the
vocabulary and not the corpus, comes to the driver."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.sources.tables import settle

DIM, TERMS, SPARE, OVERSAMPLE, POWER, SEED = 128, 1 << 15, 1 << 12, 16, 3, 42
_DOCS = 64  # texts of one block
_WORD = re.compile(r"\w\w+")


#: White space for ASCII characters that are in no word.
_APART = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def words(text: str) -> list[str]:
    """Runs of two or more word characters of the lower-cased text. What stands between white
    space and ASCII marks is a word if it is ASCII; only other pieces need to be searched."""
    pieces = text.lower().encode("utf-8", "surrogatepass").translate(_APART).decode("utf-8", "surrogatepass").split()
    if text.isascii():
        return [w for w in pieces if len(w) > 1]
    out = []
    for w in pieces:
        if not w.isascii():
            out.extend(_WORD.findall(w))
        elif len(w) > 1:
            out.append(w)
    return out


class _Columns(dict):
    """Columns by word; those without one of their own share ``spare`` more."""

    def __init__(self, terms: Sequence[str], spare: int):
        super().__init__((term, i) for i, term in enumerate(terms))
        self.first, self.spare = len(terms), spare

    def __missing__(self, word: str) -> int:
        return self.first + zlib.crc32(word.encode()) % self.spare


class LatentEmbedder:
    """A text's TF-IDF weights along the corpus's main directions, at length one.

    ``terms`` have a column each; all other words share ``spare`` more, by a hash. Weights
    are (1 + ln tf) * idf. A text without words is zero."""

    prefix = ""

    def __init__(self, terms: Sequence[str], idf: np.ndarray, axes: np.ndarray):
        self.terms, self.idf, self.axes = list(terms), np.asarray(idf, dtype=np.float64), np.asarray(axes, dtype=np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    @property
    def dim(self) -> int:
        return self.axes.shape[1]

    @property
    def model_id(self) -> str:
        return f"latent-{self.dim}-{zlib.crc32(np.ascontiguousarray(self.axes).tobytes()):08x}"

    @cached_property
    def _places(self) -> _Columns:
        return _Columns(self.terms, len(self.idf) - len(self.terms))

    def rows(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The columns of the texts' words, one text after another, their weights, of each text
        at length one, and how many each text has."""
        flat, sizes = [], []
        for text in texts:
            found = words(text)
            flat.extend(map(self._places.__getitem__, found))
            sizes.append(len(found))
        keys = np.repeat(np.arange(len(sizes)), sizes) * len(self.idf) + np.array(flat, dtype=np.int64)
        keys, times = np.unique(keys, return_counts=True)
        owner, columns = np.divmod(keys, len(self.idf))
        value = (1 + np.log(times)) * self.idf[columns]
        length = np.sqrt(np.bincount(owner, value**2, minlength=len(sizes)))
        return columns, value / length[owner], np.bincount(owner, minlength=len(sizes))

    def weights(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The columns of a text's words, and their weights at length one."""
        return self.rows([text])[:2]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for at in range(0, len(texts), _DOCS):
            block, columns = dense(*self.rows(texts[at : at + _DOCS]))
            out[at : at + _DOCS] = block @ self.axes[columns]
        return _unit(out)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.terms[i] if i < len(self.terms) else None, float(self.idf[i]), self.axes[i].tolist()) for i in range(len(self.idf))]
        spark.createDataFrame(rows, "place int, term string, idf double, axis array<float>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LatentEmbedder:
        found = spark.read.parquet(path).orderBy("place").toArrow()
        axes = found["axis"].combine_chunks().flatten().to_numpy().reshape(len(found), -1)
        return cls([t for t in found["term"].to_pylist() if t is not None], found["idf"].to_numpy(), axes)


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def dense(columns: np.ndarray, values: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A block of sparse rows, which have ``sizes`` columns each, as a matrix over the columns
    that occur in it, and these."""
    used, place = np.unique(columns.astype(np.int64), return_inverse=True)
    block = np.zeros((len(sizes), len(used)), dtype=np.float32)
    block[np.repeat(np.arange(len(sizes)), sizes), place] = values
    return block, used


def _document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, df): in how many documents each word is."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(set(words(t or "")))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], names=["term", "df"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], names=["term", "df"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def _vocabulary(docs: DataFrame, text: str, terms: int, spare: int) -> tuple[list[str], np.ndarray]:
    """The words that most documents have, at most ``terms``, and the idf of each column."""
    counts, n = settle(_document_counts(docs, text)), docs.count()
    # Some hundred steps of the logarithm of how many documents have a word.
    step = F.floor(F.log2("df") * 16)
    least, room = 1 << 62, terms
    for r in counts.groupBy(step.alias("step")).agg(F.min("df").alias("least"), F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    kept = counts.where(F.col("df") >= least).orderBy("term").toArrow()
    shared = np.zeros(spare)
    other = counts.where(F.col("df") < least).groupBy(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(spare)).alias("c")).agg(F.sum("df").alias("df"))
    for r in other.collect():
        shared[r["c"]] = min(n, r["df"])
    df = np.concatenate([kept["df"].to_numpy(), shared])
    return kept["term"].to_pylist(), np.log((1 + n) / (1 + df)) + 1


def _block(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    columns, values = part.column(0), part.column(1)
    return dense(columns.flatten().to_numpy(), values.flatten().to_numpy(), np.diff(columns.offsets.to_numpy()))


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _DOCS):
            block, used = _block(batch.slice(at, _DOCS))
            if len(used):
                yield block, used


def _applied(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times ``thin``."""
    held = rows.sparkSession.sparkContext.broadcast(thin.astype(np.float32))

    def run(batches):
        q = held.value
        total, touched = np.zeros_like(q), np.zeros(len(q), dtype=bool)
        for block, used in _blocks(batches):
            total[used] += block.T @ (block @ q[used])
            touched[used] = True
        places = np.flatnonzero(touched)
        for at in range(0, len(places), 4096):
            some = places[at : at + 4096]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.shape[1] * len(some) + 1, total.shape[1], dtype=np.int32)), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), lists], names=["place", "row"])

    def added(batches):
        for batch in batches:
            place = batch.column(0).to_numpy()
            if not len(place):
                continue
            new = np.flatnonzero(np.diff(place, prepend=-1))
            sums = np.add.reduceat(batch.column(1).flatten().to_numpy().reshape(len(place), -1).astype(np.float64), new, axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(place[new]), lists], names=["place", "row"])

    parts = rows.mapInArrow(run, "place long, row array<float>").repartition("place").sortWithinPartitions("place")
    # A row for each column of the vocabulary, and one more where a batch ends within it.
    found = parts.mapInArrow(added, "place long, row array<double>").toArrow()
    out = np.zeros(thin.shape)
    if len(found):
        np.add.at(out, found["place"].to_numpy(), found["row"].combine_chunks().flatten().to_numpy().reshape(len(found), -1))
    held.destroy()
    return out


def _gram(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """The inner products of the columns of the matrix times ``thin``."""
    held, wide = rows.sparkSession.sparkContext.broadcast(thin.astype(np.float32)), thin.shape[1]

    def run(batches):
        total = np.zeros((wide, wide))
        for block, used in _blocks(batches):
            p = (block @ held.value[used]).astype(np.float64)
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    values = rows.mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((wide, wide))
    out[values["i"].to_numpy(), values["j"].to_numpy()] = values["x"].to_numpy()
    held.destroy()
    return out


def fit(
    docs: DataFrame, dim: int = DIM, *, text: str = "text", terms: int = TERMS, spare: int = SPARE, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = SEED
) -> LatentEmbedder:
    """Learns ``dim`` directions from all texts; null ones are empty. Their signs are such
    that the largest weight of each is positive. Fewer columns than ``dim`` give zeros."""
    return _fitted(docs.select(F.lit(0).alias("id"), text), dim, text, terms, spare, oversample, power, seed)[0]


def fit_embed(
    docs: DataFrame, dim: int = DIM, *, id_col: str = "doc_id", text: str = "text", terms: int = TERMS, spare: int = SPARE, oversample: int = OVERSAMPLE, power: int = POWER, seed: int = SEED
) -> tuple[LatentEmbedder, DataFrame]:
    """What ``fit`` learns, and (id, embedding) of all texts by it, from the weights that it
    was learned from: texts aren't cut again."""
    model, rows = _fitted(docs.select(F.col(id_col).alias("id"), text), dim, text, terms, spare, oversample, power, seed)
    held = docs.sparkSession.sparkContext.broadcast(model.axes)

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, held.value.shape[1]), dtype=np.float32)
            for at in range(0, batch.num_rows, _DOCS):
                block, used = _block(batch.slice(at, _DOCS))
                out[at : at + _DOCS] = block @ held.value[used]
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(_unit(out).ravel()))], names=["id", "embedding"])

    return model, rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")


def _fitted(docs: DataFrame, dim: int, text: str, terms: int, spare: int, oversample: int, power: int, seed: int) -> tuple[LatentEmbedder, DataFrame]:
    """What is learned from (id, text), and (columns, weights, id)."""
    if min(dim, terms, spare) < 1:
        raise ValueError("dim, terms and spare must be at least 1")
    kept, idf = _vocabulary(docs, text, terms, spare)
    wide = min(len(idf), dim + oversample)
    plain = LatentEmbedder(kept, idf, np.zeros((len(idf), 1)))
    held = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches):
        for batch in batches:
            columns, weights, sizes = held.value.rows([t or "" for t in batch.column(0).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (columns.astype(np.int32), weights.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], names=["columns", "weights", "id"])

    kind = docs.schema["id"].dataType.simpleString()
    held_rows = settle(docs.select(F.col(text).cast("string").alias("text"), "id").mapInArrow(run, f"columns array<int>, weights array<float>, id {kind}"))
    held.destroy()
    # Each task sums a matrix of its own: no more tasks than twice the cores.
    rows = held_rows.select("columns", "weights").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), wide)))[0]
    for _ in range(power):
        thin = np.linalg.qr(_applied(rows, thin))[0]
    _, turn = np.linalg.eigh(_gram(rows, thin))
    axes = thin @ turn[:, ::-1][:, :dim]
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return LatentEmbedder(kept, idf, np.pad(axes, ((0, 0), (0, dim - axes.shape[1])))), held_rows
