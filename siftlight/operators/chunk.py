"""Sentence-aligned chunks of texts.

Sentences are packed while they fit; a new chunk begins with the last whole sentences of
the one before, at least one of them unless ``overlap`` is zero. A sentence longer than a
chunk is first packed by words, and a word longer than that is cut.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.functions.text import sentences

MAX_CHARS, OVERLAP = 600, 100


def packed(lengths: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of units: each is one chunk. Units are joined by single characters, so units
    a to b take ``edge[b] - edge[a] - 1``."""
    edge = [0, *accumulate(n + 1 for n in lengths)]
    out, first = [], 0
    for i in range(1, len(lengths)):
        if edge[i + 1] - edge[first] - 1 <= limit:
            continue
        out.append((first, i))
        if overlap <= 0:
            first = i
            continue
        back = i - 1
        while back > first and edge[i] - edge[back] + lengths[back - 1] <= overlap:
            back -= 1
        first = back
    if lengths:
        out.append((first, len(lengths)))
    return out


def by_words(sentence: str, limit: int) -> list[str]:
    """A long sentence in pieces of whole words, and slices of words that are too long."""
    out: list[str] = []
    open_piece = False  # whether the last piece may take another word
    for word in sentence.split():
        if len(word) > limit:
            out += [word[i : i + limit] for i in range(0, len(word), limit)]
            open_piece = False
        elif open_piece and len(out[-1]) + 1 + len(word) <= limit:
            out[-1] += " " + word
        else:
            out.append(word)
            open_piece = True
    return out


def chunks_of(parts: list[str], limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    units = [u for s in parts for u in (by_words(s, limit) if len(s) > limit else [s])]
    return [" ".join(units[a:b]) for a, b in packed([len(u) for u in units], limit, overlap)]


def chunk(df: DataFrame, key: str, text: str = "text", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, text) per chunk. Only sentence arrays go to Python; the table keeps
    its partitioning, without a shuffle."""
    if limit < 1:
        raise ValueError("chunks must have room")
    kind = df.schema[key].dataType
    cut = df.select(F.col(key).alias("key"), sentences(F.coalesce(F.col(text), F.lit(""))).alias("parts"))

    def run(batches):
        for batch in batches:
            where, numbers, out = [], [], []
            for i, parts in enumerate(batch.column(1).to_pylist()):
                found = chunks_of(parts, limit, overlap)
                where += [i] * len(found)
                numbers += range(len(found))
                out += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(numbers, pa.int32()), pa.array(out, pa.string())],
                names=["key", "ordinal", "text"],
            )

    return cut.mapInArrow(run, f"key {kind.simpleString()}, ordinal int, text string").withColumnRenamed("key", key)
