"""An adaptive context-mixing range coder for streams of token ids, and its files.

A block of ids is coded by itself: its model starts anew, and its checksum is held
against what is decoded. Three predictions are mixed. Order 2 and order 1 each name the
id that last followed the context, with a confidence; order 0 is the distribution of all
ids of the block so far. How often each prediction came true at each pair of confidences
gives the weights of the mixture
``w2 [id = named by order 2] + w1 [id = named by order 1] + w0 p(id)``,
whose three parts lie one after another in the coder's range. A range coder (48-bit
ranges, 16-bit words, carries) codes the intervals.

A block is read as up to LANES runs of equal length, each with a coder of its own but all
with one model, and numpy works on one id of every run at a time. The model learns after
a growing number of such steps; encoder and decoder learn the same at the same steps.
All arithmetic is on integers, or on doubles where they are exact, so files read alike
on any machine.

A file is: magic, version, vocabulary size; blocks (ids, words, lanes, steps, checksum,
lengths of the lanes' words, words); the documents' ids and numbers of tokens; a footer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import partition_number, shared_dir, slices, text_or_empty
from siftlight.llm.tokens import ChunkTokenizer

MAGIC, VERSION = b"CMRC", 1
LANES, STEPS = 4096, 256
BLOCK = LANES * STEPS
_ORDER0 = 18  # bits of the order-0 distribution's total
_TOTAL = 24  # bits of the mixed distribution's total
_LEAST0 = 1 << 20  # order 0 keeps this much of it, so that every id has an interval
_TABLE2 = 16  # bits of the order-2 table's index
_ID = (1 << 16) - 1
_HASH = 0x9E3779B1
_SPAN, _BASE = 1 << 48, 1 << 32  # a coder's range is above _BASE and at most _SPAN


class Model:
    """What a block has shown so far.

    An entry of a context's table is the id it names, in 16 bits, with its confidence (0
    to 7) above: from bit 16 for order 1, from bit 19 for order 2, so that both
    confidences make one number."""

    def __init__(self, vocabulary: int):
        if not 0 < vocabulary <= 1 << 16:
            raise ValueError("ids must have 16 bits")
        self.vocabulary = vocabulary
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        self.order1 = np.zeros(vocabulary, dtype=np.int32)
        self.order2 = np.zeros(1 << _TABLE2, dtype=np.int32)
        self.outcomes = np.zeros((3, 64), dtype=np.int64)
        self.spread()
        self.weigh()

    def spread(self) -> None:
        """Order 0 from the counts: at least one part for every id."""
        room = (1 << _ORDER0) - self.vocabulary
        total = int(self.counts.sum())
        share = 1 + (self.counts * room // total if total else np.full(self.vocabulary, room // self.vocabulary))
        share[int(share.argmax())] += (1 << _ORDER0) - int(share.sum())
        self.share = share.astype(np.int32)
        self.start = (np.cumsum(share) - share).astype(np.int32)
        self.inverse = np.repeat(np.arange(self.vocabulary, dtype=np.uint16), share)

    def weigh(self) -> None:
        """Weights from how often each order's id came true."""
        n = self.outcomes.sum(axis=0) + 2
        scale = (1 << _TOTAL) - _LEAST0
        self.weight2 = self.outcomes[2] * scale // n
        self.past = self.weight2 + self.outcomes[1] * scale // n

    def predictions(self, before: np.ndarray, last: np.ndarray):
        """For contexts of two ids each: the order-2 table's places, both tables' entries,
        and where the intervals of order 2 and of order 1 end."""
        place2 = (before * 0x2545F491 ^ last * _HASH) >> 12 & ((1 << _TABLE2) - 1)
        two, one = self.order2.take(place2), self.order1.take(last)
        pair = (two >> 16) | (one >> 16)
        return place2, two, one, pair, self.weight2.take(pair), self.past.take(pair)

    def intervals(self, ids: np.ndarray, two, one, w2, past) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' intervals: first that of the id named by order 2,
        then by order 1, then order 0's. An id with more than one has the first."""
        w0 = (1 << _TOTAL) - past
        first = self.start.take(ids).astype(np.int64)
        low = w0 * first >> _ORDER0
        size = (w0 * (first + self.share.take(ids)) >> _ORDER0) - low
        low += past
        hit1 = (ids == (one & _ID)) & (past > w2)
        np.copyto(low, w2, where=hit1)
        np.copyto(size, past - w2, where=hit1)
        hit2 = (ids == (two & _ID)) & (w2 > 0)
        np.copyto(low, 0, where=hit2)
        np.copyto(size, w2, where=hit2)
        return low, size

    def find(self, value: np.ndarray, two, one, w2, past):
        """The ids whose intervals hold the values, and those intervals' starts and sizes."""
        w0 = (1 << _TOTAL) - past
        # The quotient is below 2^18 and at least 2^-24 from the next integer: exact in doubles.
        at = ((((value - past + 1) << _ORDER0) - 1) / w0).astype(np.int64)
        ids = self.inverse.take(at, mode="clip").astype(np.int64)
        first = self.start.take(ids).astype(np.int64)
        low = w0 * first >> _ORDER0
        size = (w0 * (first + self.share.take(ids)) >> _ORDER0) - low
        low += past
        named = np.flatnonzero(value < past)
        if len(named):
            v, a, b = value[named], w2[named], past[named]
            by2 = v < a
            ids[named] = np.where(by2, two[named], one[named]) & _ID
            low[named] = np.where(by2, 0, a)
            size[named] = np.where(by2, a, b - a)
        return ids, low, size

    def learn(self, ids, last, place2, two, one, pair) -> None:
        """From some steps of all lanes, flattened in order of step, then lane."""
        self.counts += np.bincount(ids, minlength=self.vocabulary)
        short = ids.astype(np.int32)
        hit2, hit1 = short == (two & _ID), short == (one & _ID)
        self.outcomes += np.bincount(pair + 64 * np.where(hit2, 2, hit1), minlength=192).reshape(3, 64)
        for table, place, hit, entry, bit in ((self.order2, place2, hit2, two, 19), (self.order1, last, hit1, one, 16)):
            up = np.minimum(entry + (1 << bit), (7 << bit) | (entry & _ID))
            down = np.where(entry >= 4 << bit, entry - (4 << bit), short)
            table[place] = np.where(hit, up, down)
        self.weigh()


def _lessons(steps: int) -> list[tuple[int, bool]]:
    """After how many steps the model learns, and whether order 0 is spread anew then."""
    out, at, spread = [], 1, 1
    while at < steps:
        out.append((at, at >= spread))
        spread = at + min(at, 128) if at >= spread else spread
        at += min(at, 16)
    return [*out, (steps, False)]


def _shape(n: int) -> tuple[int, int]:
    steps = min(STEPS, max(256, -(-n // LANES)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The coded form of up to BLOCK ids."""
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, _SPAN, dtype=np.int64)
    who: list[np.ndarray] = []
    words: list[np.ndarray] = []
    zero = np.zeros((1, lanes), dtype=np.int64)
    first = 0
    for stop, spread in _lessons(steps):
        part = grid[first:stop].ravel()
        last = np.concatenate([zero, grid[: stop - 1]])[-(stop - first) :].ravel() if first < 2 else grid[first - 1 : stop - 1].ravel()
        before = np.concatenate([zero, zero, grid[: max(0, stop - 2)]])[-(stop - first) :].ravel() if first < 2 else grid[first - 2 : stop - 2].ravel()
        place2, two, one, pair, w2, past = model.predictions(before, last)
        starts, sizes = (x.reshape(-1, lanes) for x in model.intervals(part, two, one, w2, past))
        for start, size in zip(starts, sizes):
            r = span >> _TOTAL
            low += r * start
            span = r * size
            go = np.flatnonzero(span <= _BASE)
            while len(go):
                a = low[go]
                who.append(go.astype(np.uint16))
                words.append((a >> 32).astype(np.int32))  # 16 bits and a carry
                low[go] = (a & (_BASE - 1)) << 16
                s = span[go] << 16
                span[go] = s
                go = go[s <= _BASE]
        model.learn(part, last, place2, two, one, pair)
        if spread:
            model.spread()
        first = stop
    every = np.arange(lanes, dtype=np.uint16)
    for _ in range(3):
        who.append(every)
        words.append((low >> 32).astype(np.int32))
        low = (low & (_BASE - 1)) << 16
    owner, flat = np.concatenate(who), np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    flat = flat[order]
    # Carries go to the word before, which is of the same lane: a lane's first word never has one.
    carry = flat >> 16
    while carry.any():
        flat &= 0xFFFF
        flat[:-1] += carry[1:]
        carry = flat >> 16
    lengths = np.bincount(owner, minlength=lanes).astype("<u4")
    head = struct.pack("<5I", n, len(flat), lanes, steps, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + lengths.tobytes() + flat.astype("<u2").tobytes()


def decode_block(data: bytes, vocabulary: int) -> np.ndarray:
    n, total, lanes, steps, checksum = struct.unpack_from("<5I", data)
    lengths = np.frombuffer(data, "<u4", lanes, 20).astype(np.int64)
    flat = np.frombuffer(data, "<u2", total, 20 + 4 * lanes).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    code = np.zeros(lanes, dtype=np.int64)  # what the stream has above the coder's low end
    for _ in range(3):
        code = (code << 16) | flat[at]
        at += 1
    model = Model(vocabulary)
    span = np.full(lanes, _SPAN, dtype=np.int64)
    out = np.zeros((steps, lanes), dtype=np.int64)
    last = before = np.zeros(lanes, dtype=np.int64)
    first = 0
    for stop, spread in _lessons(steps):
        kept = []
        for i in range(first, stop):
            place2, two, one, pair, w2, past = model.predictions(before, last)
            r = span >> _TOTAL
            # Below 2^24, of numbers below 2^48: exact in doubles.
            value = (code / r).astype(np.int64)
            ids, start, size = model.find(value, two, one, w2, past)
            code -= r * start
            span = r * size
            go = np.flatnonzero(span <= _BASE)
            while len(go):
                code[go] = (code[go] << 16) | flat[at[go]]
                at[go] += 1
                s = span[go] << 16
                span[go] = s
                go = go[s <= _BASE]
            kept.append((last, place2, two, one, pair))
            out[i] = ids
            before, last = last, ids
        model.learn(out[first:stop].ravel(), *(np.concatenate(x) for x in zip(*kept)))
        if spread:
            model.spread()
        first = stop
    ids = out.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != checksum:
        raise ValueError("a block's checksum doesn't hold")
    return ids


def _filesystem(uri: str):
    """Any store that pyarrow knows; plain paths and file: are the local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class FileWriter:
    """Documents' ids, in order, to a file that gets its name when it is complete."""

    def __init__(self, uri: str, vocabulary: int):
        self.store, self.path = _filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.store.open_output_stream(self.part)
        self.file.write(MAGIC + struct.pack("<2I", VERSION, vocabulary))
        self.vocabulary = vocabulary
        self.held: list[bytes] = []
        self.waiting = self.blocks = self.tokens = 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids) // 4
        if self.waiting >= 4 * BLOCK:
            self._code(final=False)

    def _code(self, final: bool) -> None:
        raw = b"".join(self.held)
        at = 0
        while len(raw) - at >= 4 * BLOCK or final and at < len(raw):
            ids = np.frombuffer(raw[at : at + 4 * BLOCK], "<u4")
            coded = encode_block(ids, self.vocabulary)
            self.file.write(struct.pack("<I", len(coded)) + coded)
            self.blocks += 1
            at += 4 * len(ids)
        self.held = [raw[at:]]
        self.waiting = len(raw) - at

    def close(self) -> None:
        self._code(final=True)
        known = np.array([x is not None for x in self.doc_ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], dtype="<i8")
        index = zlib.compress(known.tobytes() + ids.tobytes() + np.array(self.sizes, dtype="<u4").tobytes(), 1)
        self.file.write(index + struct.pack("<4I", len(index), len(self.doc_ids), self.blocks, zlib.crc32(index)) + MAGIC)
        self.file.close()
        self.store.move(self.part, self.path)


def read_file(uri: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of each document of a file, block after block."""
    store, path = _filesystem(uri)
    with store.open_input_file(path) as f:
        magic, version, vocabulary = struct.unpack("<4s2I", f.read(12))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is not such a file")
        f.seek(f.size() - 20)
        size, docs, blocks, checksum = struct.unpack("<4I", f.read(20)[:16])
        f.seek(f.size() - 20 - size)
        packed = f.read(size)
        if zlib.crc32(packed) != checksum:
            raise ValueError("the index's checksum doesn't hold")
        index = zlib.decompress(packed)
        known = np.frombuffer(index, np.uint8, docs)
        ids = np.frombuffer(index, "<i8", docs, docs)
        sizes = np.frombuffer(index, "<u4", docs, 9 * docs)
        f.seek(12)
        held, at, left = b"", 0, blocks
        for k, doc_id, n in zip(known.tolist(), ids.tolist(), sizes.tolist()):
            while len(held) - at < 4 * n and left:
                (length,) = struct.unpack("<I", f.read(4))
                held, at = held[at:] + decode_block(f.read(length), vocabulary).tobytes(), 0
                left -= 1
            if len(held) - at < 4 * n:
                raise ValueError(f"{uri} ends early")
            yield (doc_id if k else None), held[at : at + 4 * n]
            at += 4 * n


def write_documents(
    docs: DataFrame, tokenizer_path: str, where: str, *, kind: str = "word_end", vocabulary: int = 49_408, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[tuple[str, int, int]]:
    """Writes files of ids in ascending order of doc_id (rows without one first, rows of
    one id by their text's hash) below ``where``, and returns (file, documents, tokens) of
    each in that order. A task that is run again writes the same file again.

    Null texts are empty (only the end id); repeated rows are all written; other columns
    are ignored; an empty table gives files without documents."""
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        encode = ChunkTokenizer.of(tokenizer_path, kind).encode
        part = partition_number()
        name = f"{where}/{part:06d}.cmrc"
        out = FileWriter(name, vocabulary)
        for ids, texts in slices(batches):
            for doc_id, coded in zip(ids, encode(texts)):
                out.add(doc_id, coded + end)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, len(out.sizes), out.tokens)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # By both: rows without an id, or of one id, needn't all go to one task.
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    # One row per partition comes back; sorting them in Spark would run the tasks twice.
    files = sorted(ordered.mapInArrow(run, "part long, file string, docs long, tokens long").collect())
    return [(r["file"], r["docs"], r["tokens"]) for r in files]


def read_documents(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in files that
    ``write_documents`` returned."""
    firsts, at = [], 0
    for name, docs, tokens in files:
        firsts.append((name, at))
        at += tokens
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for names, starts in slices(batches):
            for name, start in zip(names, starts):
                rows: list[tuple] = []
                for doc_id, ids in read_file(name):
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 8192:
                        yield _rows(rows, schema)
                        rows = []
                if rows:
                    yield _rows(rows, schema)

    listed = spark.createDataFrame(firsts, "file string, first long").repartition(max(1, len(firsts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)


def write_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    where = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read_documents(docs.sparkSession, write_documents(docs, tokenizer_path, where, **options))
