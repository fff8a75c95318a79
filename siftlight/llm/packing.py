"""Vector bin packing of examples into fixed-length sequences.

Every piece is a vector (tokens, segments, loss-bearing tokens) and every sequence has
a limit in each of the three. A sequence is filled by the dot-product heuristic
(Panigrahy et al., "Heuristics for Vector Bin Packing"): of the waiting pieces that fit
in every dimension, take the one whose demand has the largest dot product with what
the sequence has left, both in shares of the limits.

Where cutting is allowed, an example longer than a sequence first gives whole
sequences, and a gap that no waiting piece fits is filled with the head of one.
Partitions are packed independently and without a shuffle, over a pool of bounded size,
so memory doesn't grow with the input and a lost task is simply run again. The last,
partly filled sequence of a partition is cut into sequences of power-of-two lengths,
which need no padding.

Defined results: a null text is an empty one (a document of just the end id); null ids
and repeated rows are packed like any others; of equal scores the piece that waits at the
lowest place is taken; a text of any length gives whole sequences and a rest, while its ids
are held once; columns other than the two named are ignored, whatever they are called; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import partition_number, slices, text_or_empty
from siftlight.llm.tokens import ChunkTokenizer

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)
#: Sequences of one partition get consecutive ids from here on, times the partition's number.
_ROOM = 1 << 33
#: Chunks whose ids a worker remembers, twice over.
_MEMO = 200_000


class VectorPacker:
    """Packs examples that arrive one by one; yields sequences as lists of pieces.

    An example is (key, loss mask or length); a piece is (key, start, length, loss).
    ``loss`` of an example is a 0/1 array per token; None: every token bears loss.
    ``cut``: whether examples may be cut. Uncut examples that exceed a limit by
    themselves raise ValueError.
    """

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, cut: bool = True, pool: int = 768, min_cut: int = 8):
        if tokens < 1 or segments < 1 or pool < 2:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss or tokens], dtype=np.float64)
        self.cut, self.pool, self.min_cut = cut, pool, min_cut
        self.keys: list = [None] * (pool + 2)
        self.masks: list = [None] * (pool + 2)
        self.starts = np.zeros(pool + 2, dtype=np.int64)
        self.sizes = np.zeros((pool + 2, 3))
        self.n, self.masked = 0, False

    def _loss(self, mask, start: int, length: int) -> int:
        return length if mask is None else int(mask[start : start + length].sum())

    def add(self, key, length: int, mask=None) -> Iterator[list[tuple]]:
        start, cap = 0, int(self.limits[0])
        if length < 1:
            return
        self.masked |= mask is not None
        if self.cut:
            while length - start >= cap:
                take = self._fit(mask, start, cap)
                if take < cap:
                    break
                yield [(key, start, cap, self._loss(mask, start, cap))]
                start += cap
        while length > start:
            take = min(length - start, cap) if self.cut else length - start
            if self.cut:
                take = self._fit(mask, start, take)
            size = (take, 1, self._loss(mask, start, take))
            if any(size > self.limits):
                raise ValueError(f"example {key!r} exceeds a limit and may not be cut")
            self._put(key, mask, start, size)
            start += take
            if self.n >= self.pool:
                while self.n > self.pool // 4:
                    yield self._sequence()

    def _fit(self, mask, start: int, length: int) -> int:
        """The longest head that keeps within the limit on loss-bearing tokens."""
        if mask is None:
            return min(length, int(self.limits[2]))
        inside = np.cumsum(mask[start : start + length])
        return length if inside[-1] <= self.limits[2] else int(np.searchsorted(inside, self.limits[2], side="right"))

    def _put(self, key, mask, start, size) -> None:
        i = self.n
        self.keys[i], self.masks[i], self.starts[i], self.sizes[i] = key, mask, start, size
        self.n += 1

    def _drop(self, i: int) -> None:
        last = self.n = self.n - 1
        if i != last:
            self.keys[i], self.masks[i], self.starts[i], self.sizes[i] = self.keys[last], self.masks[last], self.starts[last], self.sizes[last]
        self.keys[last] = self.masks[last] = None

    def _sequence(self) -> list[tuple]:
        left, out = self.limits.copy(), []
        while self.n and left[0] > 0 and left[1] > 0:
            sizes = self.sizes[: self.n]
            score = sizes @ (left / self.limits / self.limits)
            fits = (sizes <= left).all(axis=1)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                size = self.sizes[i].copy()
                out.append((self.keys[i], int(self.starts[i]), int(size[0]), int(size[2])))
                left -= size
                self._drop(i)
                continue
            if not self.cut or left[0] < self.min_cut:
                break
            i = int(score.argmax())
            key, mask, start = self.keys[i], self.masks[i], int(self.starts[i])
            head = self._fit_left(mask, start, int(min(left[0], self.sizes[i][0])), left[2])
            if head < 1:
                break
            loss = self._loss(mask, start, head)
            out.append((key, start, head, loss))
            left -= (head, 1, loss)
            self.starts[i] += head
            self.sizes[i] -= (head, 0, loss)
            if self.sizes[i][0] < 1:
                self._drop(i)
        return out

    def _fit_left(self, mask, start: int, length: int, loss: float) -> int:
        if mask is None:
            return int(min(length, loss))
        return int(np.searchsorted(np.cumsum(mask[start : start + length]), loss, side="right"))

    def finish(self) -> Iterator[list[tuple]]:
        while self.n:
            pieces = self._sequence()
            used = sum(p[2] for p in pieces)
            if self.n or not self.cut or self.masked or used & (used - 1) == 0:
                yield pieces
            else:
                yield from self._powers(pieces, used)

    def _powers(self, pieces: list[tuple], used: int) -> Iterator[list[tuple]]:
        """``pieces``, all of whose tokens bear loss, dealt to sequences of power-of-two
        lengths, largest first."""
        rest = [(k, s, n) for k, s, n, _ in reversed(pieces)]
        for bit in range(used.bit_length() - 1, -1, -1):
            room = used & (1 << bit)
            out = []
            while room:
                key, start, length = rest.pop()
                take = min(room, length)
                out.append((key, start, take, take))
                room -= take
                if take < length:
                    rest.append((key, start + take, length - take))
            if out:
                yield out


def _packed_rows(batches, encode: Callable[[list[str]], list[bytes]], end_id: int | None, limits: dict) -> Iterator[pa.RecordBatch]:
    packer = VectorPacker(**limits)
    ids: dict[int, tuple] = {}  # serial number of a waiting document: id, its token ids, tokens not yet placed
    sequence = partition_number() * _ROOM
    rows: list[list] = [[] for _ in range(8)]
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def emit(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for serial, start, length, loss in pieces:
            doc_id, raw, left = ids[serial]
            values = (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, sequence, offset, loss)
            for column, value in zip(rows, values):
                column.append(value)
            offset += length
            if left == length:
                del ids[serial]
            else:
                ids[serial] = (doc_id, raw, left - length)
        sequence += 1

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=schema)
        for x in rows:
            x.clear()
        return batch

    serial = 0
    for doc_ids, texts in slices(batches):
        for doc_id, raw in zip(doc_ids, encode(texts)):
            raw += end
            if not raw:
                continue
            ids[serial] = (doc_id, raw, len(raw) // 4)
            for pieces in packer.add(serial, len(raw) // 4):
                emit(pieces)
            serial += 1
        if len(rows[0]) >= 4096:
            yield flush()
    for pieces in packer.finish():
        emit(pieces)
    yield flush()


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1,
    tokens: int = 2048, segments: int = 64, loss: int | None = None,
) -> DataFrame:
    """One row per piece of a document: where it starts in the document, its length and
    checksum, and its sequence and place there. Ids: the byte-level vocabulary in
    ``tokenizer_path``, then ``end_id``."""
    limits = {"tokens": tokens, "segments": segments, "loss": loss}

    def run(batches):
        return _packed_rows(batches, ChunkTokenizer.of(tokenizer_path, "byte_level", _MEMO).encode, end_id, limits)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def pack_conversations(
    turns: DataFrame, tokenizer_path: str, *, loss_roles: tuple[str, ...] = ("assistant",), end_id: int = 1,
    tokens: int = 2048, segments: int = 64, loss: int = 1536,
) -> DataFrame:
    """Instruction data: turns of a conversation in order of ``turn`` make one example,
    in which only the tokens of ``loss_roles`` bear loss. Examples are cut only at the
    limits. Same columns as ``pack_documents``; ``doc_id`` is the conversation."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def run(batches):
        encode = ChunkTokenizer.of(tokenizer_path, "byte_level", _MEMO).encode
        packer = VectorPacker(tokens=tokens, segments=segments, loss=loss)
        sequence, waiting = partition_number() * _ROOM, {}

        def emit(pieces):
            nonlocal sequence
            offset, out = 0, []
            for serial, start, length, n in pieces:
                key, raw = waiting[serial]
                out.append((key, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, sequence, offset, n))
                offset += length
            sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

        serial = 0
        for keys, all_turns in slices(batches, 64):
            for key, parts in zip(keys, all_turns):
                coded = [x + end_id.to_bytes(4, "little") for x in encode([p["text"] or "" for p in parts])]
                mask = np.concatenate([np.full(len(x) // 4, p["role"] in loss_roles, dtype=np.int64) for x, p in zip(coded, parts)])
                waiting[serial] = (key, b"".join(coded))
                for pieces in packer.add(serial, len(mask), mask):
                    yield emit(pieces)
                serial += 1
            alive = set(packer.keys[: packer.n])
            waiting = {k: v for k, v in waiting.items() if k in alive}
        for pieces in packer.finish():
            yield emit(pieces)

    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    examples = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(parts.alias("parts"))
    return examples.mapInArrow(run, SCHEMA)
