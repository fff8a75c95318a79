"""Byte-level BPE as a monoid: encode the halves of a text, then join them.

A node of the tree is a span of the text with the ids of that span. Joining two
neighbours re-encodes only a window around their boundary. The window grows on either
side, doubling, until it starts and ends where no token outside it can depend on what
is inside: at a step from a non-space to a white-space character. No alternative of the
pre-tokenizer's pattern matches across such a step, whatever surrounds it, and pieces
are merged separately; so tokens outside the window are final, which is the proof that
joining gives what encoding the whole at once would. Where no such step exists the window
is the whole of that side. Decoding concatenates the bytes of leaves up the same tree.

Defined results: a null text is an empty one, with no ids; repeated rows are coded each;
null ids pass through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import slices, text_or_empty

#: A white-space character after another: every such character that all of the libraries call one.
_STEP = re.compile(r"(?<=[!-~])[ \t\n\r]")

#: Characters of a leaf: most documents have more, and so a tree.
LEAF = 512


class TreeCodec:
    """Encodes and decodes with the ranks in a file, ``leaf`` characters at a time."""

    _open: dict[tuple, "TreeCodec"] = {}

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.plain = tiktoken.Encoding(name=path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(1, leaf)
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.bytes: list[bytes] = [b""] * len(self.sizes)
        for token, rank in ranks.items():
            self.sizes[rank], self.bytes[rank] = len(token), token

    @classmethod
    def of(cls, path: str, pattern: str, leaf: int = LEAF) -> "TreeCodec":
        key = (path, pattern, leaf)
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, stop: int) -> np.ndarray:
        if stop - start <= self.leaf:
            return self._leaf(text[start:stop])
        middle = (start + stop) // 2
        return self._join(text, start, middle, stop, self._encode(text, start, middle), self._encode(text, middle, stop))

    def _join(self, text: str, start: int, middle: int, stop: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a = self._step_before(text, start, middle)
        b = self._step_after(text, middle, stop)
        keep = len(left) - self._tokens(left[::-1], len(text[a:middle].encode()))
        skip = self._tokens(right, len(text[middle:b].encode()))
        return np.concatenate([left[:keep], self._leaf(text[a:b]), right[skip:]])

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids cover exactly ``size`` bytes."""
        if not size:
            return 0
        width = 256
        while True:
            ends = np.cumsum(self.sizes[ids[:width]])
            if ends[-1] >= size:
                at = int(np.searchsorted(ends, size))
                if ends[at] != size:
                    raise AssertionError("a window must start and end between tokens")
                return at + 1
            if width >= len(ids):
                raise AssertionError("a window must lie within the text")
            width *= 4

    @staticmethod
    def _step_before(text: str, start: int, middle: int) -> int:
        width = 64
        while True:
            low = max(start, middle - width)
            # The step at the boundary itself counts: nothing matches across it either.
            found = [m.start() for m in _STEP.finditer(text, low, min(middle + 1, len(text))) if m.start() > start]
            if found:
                return found[-1]
            if low == start:
                return start
            width *= 2

    @staticmethod
    def _step_after(text: str, middle: int, stop: int) -> int:
        width = 64
        while True:
            high = min(stop, middle + width)
            found = _STEP.search(text, middle, high)
            if found:
                return found.start()
            if high == stop:
                return stop
            width *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= max(1, self.leaf // 4):
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """doc_id and ids (array of int) per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        codec = TreeCodec.of(ranks_path, pattern, leaf)
        for keys, texts in slices(batches):
            ids = [codec.encode(t).astype(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, ranks_path: str, pattern: str, *, leaf: int = LEAF) -> DataFrame:
    """doc_id and decoded (binary) for the output of ``encode_documents``."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        codec = TreeCodec.of(ranks_path, pattern, leaf)
        for keys, ids in slices(batches):
            out = [codec.decode(np.array(x or [], dtype=np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """Encodes every text, decodes its ids, and returns the number of ids and the digests
    of both, so that neither leaves the executors."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = TreeCodec.of(ranks_path, pattern, leaf)
        for keys, texts in slices(batches):
            rows = []
            for text in texts:
                ids = codec.encode(text)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            counts, coded, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                schema=schema,
            )

    return _picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
