"""Language identification with a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; a word's label also depends
on its neighbours' through learned transitions, so that texts which switch language are
labelled word by word. Marginals come from the forward-backward algorithm, run for many
chains at a time. A document's language is the label with the largest mean marginal, and
that mean is its score.

Chains are lines, cut after ``CHAIN`` words. Training takes at most ``per_label`` whole
documents of each of at most ``most_labels`` labels, by order of a hash of their ids, of
each its first ``LONGEST`` characters; segments of them are strung together so that transitions are learned from
switches. Nothing but a row's text is used to predict.

A field only weighs its labels against each other: any word gets one. ``keep_known`` thus
asks too how many of a text's 4-grams (of its words' UTF-8 bytes, with marks at the ends)
the training texts of its words' labels hold. Texts of one half of the training rows are
counted by the other half's grams, and three quarters of what all but a twentieth of them
reach, but half of the grams at most, is the least that a label's text must have.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every
text if there is nothing to learn from; null ids aren't held out nor learned from;
repeated rows are predicted alike; of labels with equal marginals the first by name is
taken; a text of any length counts whole, runs of over 40 letters in pieces; other columns
are ignored; empty in, empty out.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.llm.common import slices, tidy

UND = "und"
CHAIN = 256
LONGEST = 20_000
_BITS = 17
_BUCKETS = 1 << _BITS
_CACHE = 250_000
_GRAM_BITS = 19
#: Longer runs of letters are cut, so that every letter is in some word.
_WORD = re.compile(r"[^\W\d_]{1,40}")
#: Characters beyond those among which the pattern above finds letters only.
_ODD = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def words_of(text: str) -> list[list[str]]:
    """Lower-case words of each chain of the text."""
    text = text.lower()
    odd = _ODD.search(text)
    chains = []
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if odd:
            words = [w for w in words if any(map(str.isalpha, w))]
        for at in range(0, len(words), CHAIN):
            chains.append(words[at : at + CHAIN])
    return chains


@dataclass
class Spelled:
    """Numbers of the affix, n-gram and identity features of many words, over their UTF-8
    bytes. ``grams`` has, for every byte of every word with its end marks, the features
    that start there, and ``starts`` where each word's bytes start; ``whole`` has the
    features that each word has once. A feature that a word lacks has number _BUCKETS."""

    grams: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    whole: np.ndarray


def spell(words: list[str]) -> Spelled:
    raw = [f"^{w}$".encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    octets = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
    n = int(ends[-1])
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes from here to the word's end
    grams, code = np.empty((3, n), dtype=np.int64), np.zeros(n, dtype=np.uint64)
    for i in range(3):
        code = code << np.uint64(8) | octets[i : i + n]
        grams[i] = np.where(left > i, _bucket(code, i), _BUCKETS)
    whole = np.empty((11, len(raw)), dtype=np.int64)
    head, tail = np.zeros((2, len(raw)), dtype=np.uint64)
    for i in range(5):
        head = head << np.uint64(8) | octets[np.minimum(starts + 1 + i, n)]
        tail = tail << np.uint64(8) | octets[np.maximum(ends - 2 - i, 0)]
        for row, value in ((i, head), (5 + i, tail)):
            whole[row] = np.where(sizes - 2 > i, _bucket(value, 3 + row), _BUCKETS)
    whole[10] = _bucket(np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw)), 13)
    return Spelled(grams, starts, sizes, whole)


def _gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the 4-grams of all words, end to end, and how many each word has."""
    raw = [f"^{w}$".encode().ljust(4, b"$") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    octets = np.frombuffer(b"".join(raw) + bytes(4), np.uint8).astype(np.uint64)
    n = int(sizes.sum())
    code = octets[:n] << np.uint64(24) | octets[1 : n + 1] << np.uint64(16) | octets[2 : n + 2] << np.uint64(8) | octets[3 : n + 3]
    inside = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) >= 4
    return (code[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _GRAM_BITS)).astype(np.int64), sizes - 3


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    mixed = (code + np.uint64(kind << 44)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    #: A row per feature, then one of zeros, then one for each label's lexicon.
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    #: A row per 4-gram's number, whether each label knows it; and the least share of known ones.
    known: np.ndarray | None = None
    least_known: np.ndarray | None = None
    cache: dict[str, int] = field(default_factory=dict)
    emissions: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "emissions": None}

    def _emissions(self, words: list[str]) -> np.ndarray:
        spelled = spell(words)
        scores = self.weights[spelled.whole].sum(axis=0)
        for row in spelled.grams:
            scores += np.add.reduceat(self.weights[row], spelled.starts)
        for i, word in enumerate(words):
            own = self.lexicon.get(word)
            if own is not None:
                scores[i] += self.weights[_BUCKETS + 1 + own]
        return np.exp(scores - scores.max(axis=1, keepdims=True))

    def rows(self, words: list[str]) -> np.ndarray:
        """Emission potentials of words, by way of a bounded cache of words."""
        if len(self.cache) > _CACHE or self.emissions is None:
            self.cache = {}
            self.emissions = np.zeros((0, len(self.labels)), dtype=np.float32)
        cache = self.cache
        new = [w for w in set(words) if w not in cache]
        if new:
            room = len(cache) + len(new)
            if room > len(self.emissions):
                more = np.zeros((max(room, 2 * len(self.emissions)), len(self.labels)), dtype=np.float32)
                more[: len(cache)] = self.emissions[: len(cache)]
                self.emissions = more
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.emissions[len(cache) : len(cache) + len(part)] = self._emissions(part)
                cache.update(zip(part, range(len(cache), len(cache) + len(part))))
        return self.emissions[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, chains: list[list[str]]) -> np.ndarray:
        """A row per word of all chains in order: the probabilities of the labels."""
        words = list(itertools.chain.from_iterable(chains))
        if not words:
            return np.zeros((0, len(self.labels)))
        return forward_backward(self.rows(words), np.array([len(c) for c in chains if c]), np.exp(self.transitions))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(label, score) for label, score, _ in self.judge(texts)]

    def _known_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the grams that each label knows, and all."""
        kinds = list(dict.fromkeys(words))
        place = dict(zip(kinds, range(len(kinds))))
        numbers, sizes = _gram_buckets(kinds)
        counts = np.add.reduceat(self.known[numbers].astype(np.int64), np.cumsum(sizes) - sizes)
        which = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return counts[which], sizes[which]

    def judge(self, texts: list[str | None], familiar: bool = False) -> list[tuple[str, float, float]]:
        """(label, score, margin): by how much the share of known grams is over the least
        (0 unless ``familiar``)."""
        if not self.labels:
            return [(UND, 0.0, 0.0)] * len(texts)
        chains = [words_of(t or "") for t in texts]
        sizes = np.array([sum(map(len, c)) for c in chains])
        found = self.marginals([c for own in chains for c in own if c])
        some = np.flatnonzero(sizes)
        out = [(UND, 0.0, 0.0)] * len(texts)
        if not len(some):
            return out
        starts = (np.cumsum(sizes) - sizes)[some]
        mean = np.add.reduceat(found, starts) / sizes[some, None]
        best, margin = mean.argmax(axis=1), np.zeros(len(some))
        if familiar:
            counts, every = self._known_counts([w for own in chains for c in own for w in c])
            margin = np.add.reduceat((counts * found).sum(axis=1), starts) / np.add.reduceat(every, starts) - mean @ self.least_known
        for i, label, score, over in zip(some.tolist(), best.tolist(), mean[np.arange(len(some)), best].tolist(), margin.tolist()):
            out[i] = (self.labels[label], min(1.0, score), over)
        return out


def forward_backward(potentials: np.ndarray, sizes: np.ndarray, moves: np.ndarray, together: int = 1024) -> np.ndarray:
    """Marginals of chains that lie end to end in ``potentials``. Chains of about equal
    length go through the recursions together, scaled at each step."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty(potentials.shape, dtype=np.float64)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), together):
        group = order[at : at + together]
        n, first = sizes[group], starts[group]
        longest = int(n[0])
        active = np.searchsorted(-n, -np.arange(longest), side="left")  # chains longer than t
        ahead = []
        for t in range(longest):
            e = potentials[first[: active[t]] + t].astype(np.float64)
            a = e if t == 0 else (ahead[-1][: active[t]] @ moves) * e
            ahead.append(a / a.sum(axis=1, keepdims=True))
        back = np.ones((active[-1], len(moves)))
        for t in range(longest - 1, -1, -1):
            if active[t] > len(back):
                back = np.concatenate([back, np.ones((active[t] - len(back), len(moves)))])
            g = ahead[t] * back
            out[first[: active[t]] + t] = g / g.sum(axis=1, keepdims=True)
            back = (back * potentials[first[: active[t]] + t]) @ moves.T
            back /= back.sum(axis=1, keepdims=True)
    return out


def train(labelled: list[tuple[str, str]], seed: int = 42, chains: int = 4000, length: int = 32, passes: int = 3) -> Model:
    """Fits the field to (text, label) by stochastic gradient (AdaGrad) on the chains'
    log-likelihood."""
    labels = sorted({label for text, label in labelled if any(words_of(text))})
    k = len(labels)
    if not k:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), {})
    by_label: list[list[list[str]]] = [[] for _ in labels]
    counts: dict[str, np.ndarray] = {}
    for text, label in labelled:
        if label in labels:
            i = labels.index(label)
            for chain in words_of(text):
                by_label[i].append(chain)
                for w in chain:
                    counts.setdefault(w, np.zeros(k))[i] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 3 and c.max() >= 0.9 * c.sum()}
    rng = np.random.default_rng(seed)
    model = Model(labels, np.zeros((_BUCKETS + 1 + k, k)), np.zeros((k, k)), lexicon)
    data = [_strung(by_label, rng, length) for _ in range(chains)]
    numbers = _numbers(list(dict.fromkeys(w for words, _ in data for w in words)), lexicon)
    grown, grown_moves = np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6)
    size = 50
    for _ in range(passes):
        order = rng.permutation(len(data))
        for at in range(0, len(order), size):
            batch = [data[i] for i in order[at : at + size]]
            words = [w for chain, _ in batch for w in chain]
            gold = np.array([y for _, ys in batch for y in ys])
            kinds = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(kinds)}
            which = np.array([place[w] for w in words])
            flat = np.concatenate([numbers[w] for w in kinds])
            sizes = np.array([len(numbers[w]) for w in kinds])
            scores = np.add.reduceat(model.weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
            scores -= scores.max(axis=1, keepdims=True)
            e = np.exp(scores)[which].reshape(len(batch), length, k)
            moves = np.exp(model.transitions)
            node, pair = _expectations(e, moves)
            y = gold.reshape(len(batch), length)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1], y[:, 1:]), 1)
            slope_moves = (pair - seen) / len(batch) + 1e-3 * model.transitions
            slope = node.reshape(-1, k).copy()
            slope[np.arange(len(gold)), gold] -= 1
            of_kind = np.zeros((len(kinds), k))
            np.add.at(of_kind, which, slope)
            touched, back = np.unique(flat, return_inverse=True)
            total = np.zeros((len(touched), k))
            np.add.at(total, back, np.repeat(of_kind / len(batch), sizes, axis=0))
            total += 1e-5 * model.weights[touched]
            grown[touched] += total**2
            model.weights[touched] -= 0.1 * total / np.sqrt(grown[touched])
            grown_moves += slope_moves**2
            model.transitions -= 0.1 * slope_moves / np.sqrt(grown_moves)
    model.weights = model.weights.astype(np.float32)
    model.known, model.least_known = _familiar(labelled, labels)
    return model


def _familiar(labelled: list[tuple[str, str]], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams each label knows, and the least share of known ones in its texts. Grams
    of a single text don't count where a label has 20 or more."""
    known, least = np.zeros((1 << _GRAM_BITS, len(labels)), dtype=bool), np.zeros(len(labels))
    for i, label in enumerate(labels):
        texts = [_gram_buckets(words)[0] for words in (list(itertools.chain.from_iterable(words_of(t))) for t, own in labelled if own == label) if words]
        halves = [np.zeros(1 << _GRAM_BITS, dtype=np.int64) for _ in range(2)]
        for n, grams in enumerate(texts):
            halves[n % 2][np.unique(grams)] += 1
        known[:, i] = halves[0] + halves[1] >= (2 if len(texts) >= 20 else 1)
        shares = [(halves[1 - n % 2][grams] >= (2 if len(texts) >= 40 else 1)).mean() for n, grams in enumerate(texts)] if len(texts) > 1 else [0.0]
        least[i] = min(0.5, 0.75 * float(np.quantile(shares, 0.05)))
    return known, least


def _numbers(words: list[str], lexicon: dict[str, int]) -> dict[str, np.ndarray]:
    """The numbers of the features that each word has."""
    spelled, out = spell(words), {}
    for i, word in enumerate(words):
        at, n = spelled.starts[i], spelled.sizes[i]
        own = np.concatenate([spelled.grams[:, at : at + n].ravel(), spelled.whole[:, i], [_BUCKETS + 1 + lexicon.get(word, -1)]])
        out[word] = own[own != _BUCKETS]
    return out


def _strung(by_label, rng, length: int) -> tuple[list[str], list[int]]:
    """A chain of runs of words, each of one label."""
    words: list[str] = []
    ys: list[int] = []
    while len(words) < length:
        label = int(rng.integers(len(by_label)))
        line = by_label[label][int(rng.integers(len(by_label[label])))]
        if not line:
            continue
        n = int(rng.integers(1, 17))
        start = int(rng.integers(max(1, len(line) - n + 1)))
        words += line[start : start + n]
        ys += [label] * len(line[start : start + n])
    return words[:length], ys[:length]


def _expectations(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes, and summed marginals of pairs, of chains of one length."""
    n, length, k = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    a = e[:, 0]
    ahead[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (ahead[:, t - 1] @ moves) * e[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (back[:, t + 1] * e[:, t + 1]) @ moves.T
        back[:, t] = b / b.sum(axis=1, keepdims=True)
    node = ahead * back
    node /= node.sum(axis=2, keepdims=True)
    left, right = ahead[:, :-1].reshape(-1, k), (back[:, 1:] * e[:, 1:]).reshape(-1, k)
    weight = ((left @ moves) * right).sum(axis=1, keepdims=True)
    return node, moves * ((left / weight).T @ right)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_label: int = 250, *, most_labels: int = 256, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``per_label`` (text, label) rows of each label that aren't held out: those
    of the smallest hashes. Of more than ``most_labels`` labels, the most frequent count. A first count tells how small a hash must be, so that no
    label's rows have to be sorted whole."""
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    counts = docs.where(usable).groupBy(F.col(label_col).cast("string").alias("label")).count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(17)), 11) / F.lit(float(1 << 53))
    rows = docs.where(usable & F.col(text_col).isNotNull()).select(
        F.left(F.col(text_col), F.lit(LONGEST)).alias("text"), F.col(label_col).cast("string").alias("label"), draw.alias("draw"), F.col(id_col).alias("id")
    )
    few = counts.orderBy(F.desc("count"), "label").limit(most_labels).select(F.col("label").alias("of"), (F.lit(3.0 * per_label) / F.col("count")).alias("share"))
    near = rows.join(F.broadcast(few), F.col("label") == F.col("of")).where("draw < share")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id", "text"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= per_label).orderBy("label", "rank")
    return [(r["text"], r["label"]) for r in picked.select("text", "label").collect()]


def fit(docs: DataFrame, per_label: int = 250, **columns) -> Model:
    return train(training_rows(docs, per_label, **columns))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score per document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for ids, out, texts in slices(batches):
            found = held.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                schema=schema,
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and runs of words of one language: (lang, words, score), in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("words", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for ids, texts in slices(batches):
            out = []
            for text in texts:
                chains = [c for c in words_of(text or "") if c] if held.value.labels else []
                p = held.value.marginals(chains) if chains else np.zeros((0, 1))
                best, runs = p.argmax(axis=1), []
                for at in np.flatnonzero(np.diff(best, prepend=-1)).tolist():
                    end = at + int((np.flatnonzero(np.diff(best[at:], append=-1))[:1] + 1)[0])
                    runs.append({"lang": held.value.labels[best[at]], "words": end - at, "score": float(p[at:end, best[at]].mean())})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(kind))], names=["doc_id", "runs"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, runs array<struct<lang:string,words:long,score:double>>")


def keep_known(docs: DataFrame, model: Model, *, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model tells with at least ``least``, and of
    whose 4-grams that language's training texts hold enough."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts, good = batch.column(names.index(text_col)), []
            for at in range(0, batch.num_rows, 256):
                good += [x != UND and s >= least and over >= 0 for x, s, over in held.value.judge(texts.slice(at, 256).to_pylist(), familiar=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
