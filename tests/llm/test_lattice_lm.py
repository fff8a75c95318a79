"""Lattice likelihoods against sums over all spellings, and the query against brute force."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from siftlight.llm import lattice_lm as L
from siftlight.llm import queries as Q

MODEL = P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "The the THE", "x" * 300, "x" * 300, "é" * 50, "日本 語\x85テキスト　x", "a\x1cb \x0b\x0cc", "▁ ▁▁a", "nul\x00l", "word " * 3000, "z" * 65 + " " + "z" * 64, "z" * 65 + "\n" + "q" * 70_000,
]


@pytest.fixture(scope="module")
def lattice():
    return L.Lattice.load(MODEL)


def pieces_of(lattice):
    """Pieces of at most three bytes by their spelling."""
    after, out, todo = collections.defaultdict(list), {}, [(0, b"")]
    for key, state in zip(lattice.keys.tolist(), lattice.to.tolist()):
        after[key // 256].append((bytes([key % 256]), state))
    while todo:
        state, spelled = todo.pop()
        if lattice.piece[state] >= 0:
            out[spelled] = int(lattice.piece[state])
        todo += [(t, spelled + b) for b, t in after[state]] if len(spelled) < 3 else []
    return out


def test_all_spellings_count(lattice):
    """Every way to cut a short word into pieces, one by one."""
    known, words = pieces_of(lattice), [b"ab", b"is", b"q", "é".encode()]
    counts = np.array([3.0, 5.0, 1.0, 2.0])
    total, used = [], np.zeros(len(lattice.weights))
    for word, n in zip(words, counts):
        s, each = b" " + word, []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(s)]
            parts = [known.get(s[a:b]) for a, b in zip([0, *ends], ends)]
            if None not in parts:
                each.append((sum(lattice.weights[p] for p in parts), parts))
        z = math.log(sum(math.exp(w) for w, _ in each))
        total.append(z)
        for w, parts in each:
            for p in parts:
                used[p] += n * math.exp(w - z)
    assert np.allclose(lattice.likelihoods(words), total)
    assert np.allclose(lattice.expected(words, counts), used)


def test_long_words_and_many(lattice):
    assert len(lattice.likelihoods([])) == 0 and not lattice.expected([], np.empty(0)).any()
    words = [b"a" * n for n in (1, 5000, 300_000)]
    found = lattice.likelihoods(words)
    assert np.isfinite(found).all() and found[2] < found[1] < found[0]
    assert np.allclose(found[:2], [lattice.likelihoods([w])[0] for w in words[:2]])
    steps = dict(zip(lattice.keys.tolist(), lattice.to.tolist()))
    runs = [b" " + b"a" * 1023, *[b"a" * 1024] * 3, b"a" * 905]
    assert found[1] == pytest.approx(sum(plain(r, lattice, steps, b"") for r in runs) * math.log(10))
    # A piece of each kind spells every byte, whatever the run.
    assert lattice.expected(words, np.ones(3)).sum() > 0 and lattice.expected([b"q" * 3000], np.array([2.0])).sum() <= 2 * 3001


def test_training_raises_likelihood(spark, sf, lattice):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = L.count_words(docs).persist()
    assert counts.where("length(key) = 0").first()["n"] == docs.count()
    words = [(r["long"] or r["key"], r["trained"]) for r in counts.where("trained > 0 AND length(key) > 0").collect()]
    n = np.array([t for _, t in words])
    fits = [(lattice.trained(counts, rounds).likelihoods([w for w, _ in words]) * n).sum() for rounds in (0, 1, 2)]
    assert fits[0] < fits[1] < fits[2]
    assert abs(np.exp(lattice.trained(counts, 1).weights).sum() - 1) < 1e-9
    counts.unpersist()


def plain(word, lattice, steps, mark=b" "):
    """The forward recursion of one word, an edge at a time."""
    s = mark + word
    ahead = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        state = 0
        for j in range(i, len(s)):
            state = steps.get(state * 256 + s[j])
            if state is None:
                break
            if lattice.piece[state] >= 0:
                ahead[j + 1] = np.logaddexp(ahead[j + 1], ahead[i] + lattice.weights[lattice.piece[state]])
    return ahead[-1] / math.log(10)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_scores(spark, texts, lattice, frequent):
    """With all words broadcast, and with nearly all joined."""
    rows = [(i, t, "x", 1.0, 2) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, score double, row int").repartition(3)
    found = L.score_documents(docs, MODEL, rounds=1, frequent=frequent).collect()
    cut = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts]
    counts = collections.Counter(w for words, h in zip(cut, held) if not h for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    model = lattice.trained(L.count_words(docs), 1)
    steps = dict(zip(model.keys.tolist(), model.to.tolist()))
    like = {w: plain(w, model, steps) for words in cut for w in words if len(w) < 1000} | {b"q" * 70_000: model.likelihoods([b"q" * 70_000])[0] / math.log(10)}
    want = []
    for (i, _), words, h in zip(texts, cut, held):
        tokens = [*words, None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        score = sum(like[w] for w in words) + model.weights[-1] / math.log(10)
        want.append((i if i is not None else -1, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in found]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_nothing_to_learn_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_documents(empty, MODEL).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = L.score_documents(spark.createDataFrame([(only, "some Words")], "doc_id long, text string"), MODEL).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["base_score"] == 0 and -60 < row["score"] < 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = Q.op11_lattice_lm(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert rows.count() == docs.count() == rows.join(docs.select("doc_id"), "doc_id").where(F.col("score") < 0).count()
