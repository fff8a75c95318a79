"""Document likelihoods under a lattice of subword pieces.

A document is its words, each behind a mark, and one end. Every way of spelling the marked
words by pieces of an existing vocabulary counts: a spelling weighs the product of its
pieces' probabilities, and the forward recursion sums all spellings, in logarithms. A mark
begins a piece or stands alone, so that the lattice of a document is its words' lattices in
a row: a word's likelihood is found once, wherever it stands. Each single byte is a piece
too, so no word is impossible. A word of over ``_RUN`` bytes is runs of so many, one behind
the other, that no piece crosses; they are spelled at the same time.

The vocabulary's scores are ranks of pieces (minus the rank); a Zipf law over them gives the
weights at first. ``rounds`` steps of expectation and maximization over the counts of all
training words then make probabilities of them, with the first weights as a prior that
counts as much as the pieces are many. Pieces are never added, dropped or joined.

``score_documents`` counts words in each task first, keeps one row per distinct word, and
looks the words of a document up in a broadcast of the most frequent words, at most
``frequent`` of at most ``_KEY`` bytes each; the others meet their row in a join. A word that
is not in the broadcast is rare among all rows, so no key of that join is hot.

Defined results: a null text is empty, and an empty one has the end alone; rows with a null
id train, and aren't held out; repeated rows count and are scored each; words of any length
count whole (those of over ``_KEY`` bytes are known by their SHA-256); without training rows
the first weights hold, and the base score is 0; other columns are ignored, whatever their
names; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import partition_number, settle, tidy

_KEY = 64  # bytes of a word that is its own key
_PORTION = 8 << 20  # bytes of text split at a time
_HELD = 1 << 20  # distinct words that a task counts before it hands them on
_WORDS = 16_384  # words in one lattice
_RUN = 1024  # bytes of a word, with its mark, that pieces don't reach out of
_MARK = b" "  # no word holds it
_END = b""  # no word is empty
_ZIPF = 2.7


@dataclass(frozen=True)
class Lattice:
    """The pieces as an automaton over bytes: from the state ``keys // 256`` the byte
    ``keys % 256`` leads to ``to``; ``piece`` is the piece that a state has spelled, or -1.
    ``weights``: natural logarithms, the end's last."""

    keys: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    weights: np.ndarray

    @classmethod
    def load(cls, path: str) -> Lattice:
        """The pieces that can occur behind a mark in lower-cased text, and all bytes."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks: dict[bytes, float] = {}
        last = max((-model.get_score(i) for i in range(model.vocab_size()) if model.get_score(i) > -1e8), default=0.0)
        for i in range(model.vocab_size()):
            shown = model.id_to_piece(i).replace("▁", " ").encode()
            odd = model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)
            if not odd and _MARK not in shown[1:] and not any(65 <= b <= 90 for b in shown):
                ranks[shown] = -model.get_score(i)
        weight = {piece: 1 / (_ZIPF + rank) for piece, rank in ranks.items()}
        for byte in range(256):
            weight[bytes([byte])] = weight.get(bytes([byte]), 0.0) + 1 / (_ZIPF + last)
        return cls._of(sorted(weight), np.array([*(weight[x] for x in sorted(weight)), 1 / _ZIPF]))

    @classmethod
    def _of(cls, pieces: list[bytes], weights: np.ndarray) -> Lattice:
        states, spelled = {b"": 0}, [-1]
        for place, piece in enumerate(pieces):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in states:
                    states[piece[:n]] = len(spelled)
                    spelled.append(-1)
            spelled[states[piece]] = place
        steps = sorted((states[x[:-1]] * 256 + x[-1], state) for x, state in states.items() if x)
        keys, to = np.array(steps, dtype=np.int64).T
        return cls(keys, to, np.array(spelled), np.log(weights / weights.sum()))

    def _edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(from, to, piece, place of ``from`` in its run) of all edges; first node and length
        of each run, and whose word's it is."""
        data = np.frombuffer(_MARK + _MARK.join(words), dtype=np.uint8)
        first = np.flatnonzero(data == _MARK[0])
        size = np.diff(np.append(first, len(data)))
        runs = -(-size // _RUN)
        word = np.repeat(np.arange(len(first)), runs)
        start = _RUN * (np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs))
        first, size = first[word] + start, np.minimum(_RUN, size[word] - start)
        ends, which = np.repeat(first + size, size), np.repeat(np.arange(len(first)), size)
        at, state = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
        found, length = [], 0
        while len(at):
            key = state * 256 + data[at + length]
            step = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[step] == key
            at, state, length = at[known], self.to[step[known]], length + 1
            whole = self.piece[state] >= 0
            found.append((at[whole], np.full(whole.sum(), length), self.piece[state[whole]]))
            more = at + length < ends[at]
            at, state = at[more], state[more]
        at, length, piece = (np.concatenate(x) for x in zip(*found))
        node = at + which[at]
        return node, node + length, piece, at - first[which[at]], first + np.arange(len(first)), size, word

    @staticmethod
    def _sweep(value: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray, gain: np.ndarray) -> None:
        """Adds up, in logarithms, what reaches each target, in the order of ``step``."""
        order = np.lexsort((target, step))
        source, target, step, gain = source[order], target[order], step[order], gain[order]
        for a, b in zip(cuts := np.flatnonzero(np.diff(step, prepend=-1)), [*cuts[1:], len(step)]):
            new = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            value[target[a:b][new]] = np.logaddexp.reduceat(value[source[a:b]] + gain[a:b], new)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """The natural logarithm of each word's probability: the sum of all its spellings."""
        out = [np.empty(0)]
        for some in _blocks(words):
            source, target, piece, place, first, size, word = self._edges(some)
            ahead = np.full(first[-1] + size[-1] + 1, -np.inf)
            ahead[first] = 0.0
            self._sweep(ahead, source, target, place + target - source, self.weights[piece])
            out.append(np.bincount(word, ahead[first + size]))
        return np.concatenate(out)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece spells the words, by its share of all their spellings."""
        total, at = np.zeros(len(self.weights)), 0
        for some in _blocks(words):
            source, target, piece, place, first, size, word = self._edges(some)
            gain, n = self.weights[piece], first[-1] + size[-1] + 1
            ahead, back = np.full(n, -np.inf), np.full(n, -np.inf)
            ahead[first], back[first + size] = 0.0, 0.0
            self._sweep(ahead, source, target, place + target - source, gain)
            run = np.searchsorted(first, source, side="right") - 1
            self._sweep(back, target, source, size[run] - place, gain)
            share = np.exp(ahead[source] + gain + back[target] - ahead[first + size][run])
            total += np.bincount(piece, share * counts[at : at + len(some)][word[run]], minlength=len(total))
            at += len(some)
        return total

    def trained(self, counts: DataFrame, rounds: int) -> Lattice:
        """The weights after ``rounds`` steps over ``counts`` (key, long, trained)."""
        prior, now, words = np.exp(self.weights), self, counts.where("trained > 0").select("key", "long", "trained")
        for _ in range(rounds):
            held = counts.sparkSession.sparkContext.broadcast(now)

            def run(batches, held=held):
                total = np.zeros(len(held.value.weights))
                for batch in batches:
                    n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                    words, ends = _spelled(batch)
                    total += held.value.expected(words, n[~ends])
                    total[-1] += n[ends].sum()
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

            # A row for each piece of the vocabulary at most.
            rows = words.mapInArrow(tidy(run), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
            seen = np.zeros(len(prior))
            seen[[r["piece"] for r in rows]] = [r["n"] for r in rows]
            held.destroy()
            now = replace(now, weights=np.log((seen + len(prior) * prior) / (seen.sum() + len(prior))))
        return now


def _blocks(words: list[bytes]) -> Iterator[list[bytes]]:
    """At most so many words at a time, and about 20 bytes of each."""
    some, room = [], 20 * _WORDS
    for word in words:
        some.append(word)
        room -= len(word)
        if len(some) == _WORDS or room <= 0:
            yield some
            some, room = [], 20 * _WORDS
    if some:
        yield some


def _spelled(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The words of (key, long, ...), without the end; where the end is."""
    keys = pc.coalesce(batch.column(1), batch.column(0))
    ends = pc.equal(pc.binary_length(keys), 0).to_numpy(zero_copy_only=False)
    return keys.filter(pa.array(~ends)).to_pylist(), ends


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch``, so many at a time that their texts have about ``_PORTION`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // _PORTION
    cuts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and of which text each is."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().cast(pa.binary())
    which = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), which[real.to_numpy(zero_copy_only=False)]


def _keyed(words: pa.Array) -> pa.Array:
    """The words, long ones as a mark (which no word holds) and their digest."""
    long = pc.greater(pc.binary_length(words), _KEY)
    if not pc.any(long).as_py():
        return words
    digests = [_MARK + hashlib.sha256(w).digest() for w in words.filter(long).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(digests, pa.binary()))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, long, trained, n): a row per distinct word, and one for the end, whose key is
    empty; ``long`` is the word where it isn't its own key."""
    schema = pa.schema([("key", pa.binary()), ("long", pa.binary()), ("trained", pa.int64()), ("n", pa.int64())])

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["key", "long"]).aggregate([("trained", "sum"), ("n", "sum")])
        return sums.select(["key", "long", "trained_sum", "n_sum"]).rename_columns(schema.names)

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            for part in _portions(batch, 1):
                words, which = _words(part.column(1))
                trains = pc.invert(part.column(0)).cast(pa.int64())
                ends = pa.array([_END] * len(part), pa.binary())
                words = pa.concat_arrays([words, ends])
                trained = pa.concat_arrays([trains.take(pa.array(which)), trains])
                long = pc.if_else(pc.greater(pc.binary_length(words), _KEY), words, pa.scalar(None, pa.binary()))
                table = pa.table([_keyed(words), long, trained, pa.array(np.ones(len(words), dtype=np.int64))], schema=schema)
                held.append(merged([table]))
                if sum(map(len, held)) > _HELD:
                    held = [merged(held)]
                    if len(held[0]) > _HELD // 2:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=65_536)
        if held:
            yield from merged(held).combine_chunks().to_batches(max_chunksize=65_536)

    picked = docs.select(held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    rows = picked.mapInArrow(tidy(run), "key binary, long binary, trained long, n long")
    return rows.groupBy("key", "long").agg(F.sum("trained").alias("trained"), F.sum("n").alias("n"))


def _known(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """(key, trained, n, logp): with each word's likelihood, and the end's."""
    held = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        for batch in batches:
            words, ends = _spelled(batch)
            logp = np.full(len(ends), held.value.weights[-1])
            logp[~ends] = held.value.likelihoods(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(logp)], names=["key", "trained", "n", "logp"])

    return counts.mapInArrow(tidy(run), "key binary, trained long, n long, logp double")


def _least(known: DataFrame, frequent: int) -> int:
    """How often a word occurs at least if at most ``frequent`` words occur as often."""
    # A word belongs to one of some hundred steps of its count's logarithm.
    step = F.floor(F.log2("n") * 8)
    rows = known.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    room, least = frequent, 1 << 62
    for r in rows:
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    return least


def score_documents(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, frequent: int = 1 << 18
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): the base-10
    logarithms of each text's probability by add-half counts of words, and by the lattice."""
    counts = settle(count_words(docs, id_col, text_col))
    known = settle(_known(counts, Lattice.load(model_path).trained(counts, rounds)))
    totals = known.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
    norm = math.log10(totals["n"] + 0.5 * (totals["v"] + 1))
    known = known.select("key", "n", (F.col("trained") > 0).cast("long").alias("seen"), (F.log10(F.col("trained") + 0.5) - norm).alias("base"), (F.col("logp") / math.log(10)).alias("model"))
    least = _least(known, frequent)
    # At most ``frequent`` rows of at most _KEY bytes, and the end.
    top = known.where((F.col("n") >= least) | (F.length("key") == 0)).select("key", "seen", "base", "model").toArrow()
    keys = top["key"].combine_chunks()
    values = np.stack([top[c].to_numpy().astype(float) for c in ("seen", "base", "model")], axis=1)
    end = values[keys.to_pylist().index(_END)] if _END in keys.to_pylist() else np.zeros(3)
    # No partition has 2^32 rows.
    held = docs.sparkSession.sparkContext.broadcast((keys, values, end))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("sums", pa.list_(pa.float64())), ("rest", pa.list_(pa.binary()))])

    def run(batches):
        keys, values, end = held.value
        row = partition_number() << 32
        for batch in batches:
            for part in _portions(batch, 2):
                words, which = _words(part.column(2))
                words, n = _keyed(words), len(part)
                place = pc.index_in(words, value_set=keys)
                rare = place.is_null().to_numpy(zero_copy_only=False)
                own = values[pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[~rare]]
                sums = np.stack([np.bincount(which[~rare], own[:, c], minlength=n) for c in range(3)], axis=1) + end
                offsets = np.concatenate([[0], np.cumsum(np.bincount(which[rare], minlength=n))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(rare)))
                tokens = pa.array(np.bincount(which, minlength=n) + 1)
                thirds = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column(0), part.column(1), tokens, thirds, rest], schema=schema)
                row += n

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    parts = settle(picked.mapInArrow(tidy(run), "row long, doc_id long, held_out boolean, n_tokens long, sums array<double>, rest array<binary>"))
    rest = parts.where(F.size("rest") > 0).select("row", F.explode("rest").alias("key")).join(known.where(F.col("n") < least), "key")
    more = rest.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("seen", "base", "model")))
    whole = lambda i, c: F.col("sums")[i] + F.coalesce(c, F.lit(0))
    return parts.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", whole(0, "seen").cast("long").alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        whole(1, "base").alias("base_score"), whole(2, "model").alias("score"),
    )
