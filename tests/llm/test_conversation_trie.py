"""The trie of conversations against sets of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftlight.llm import conversation_trie as T
from siftlight.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n int, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], digest))
    return order(out)


def order(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r))


def made(spark, rows, limit=None):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    return order(tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(T.with_shared_heads(T.ordered_turns(df)), limit).collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = Q.op13_conversation_trie(spark, sf)
    assert found.columns == COLUMNS
    assert order(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("limit", [15, 40, None])
def test_many_shared_turns(spark, limit):
    """Long common heads, hot conversations, and subtries that are dealt anew several times."""
    rng = random.Random(7)
    rows = []
    for c in range(320):
        long = ["a"] * 12 + [rng.choice("bc") for _ in range(rng.randrange(6))]
        texts = long if c % 3 == 0 else ["hot", "case"] if c % 3 == 1 else [rng.choice("defgh") for _ in range(rng.randrange(1, 5))]
        rows += [(c, i, "user" if i % 2 else "system", t * (i + 1)) for i, t in enumerate(texts)]
    assert made(spark, rows, limit) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "a", "tie"), (2, None, "", ""), (2, 0, "user", "x"), (None, 0, "user", "none"), (None, 1, None, "y"),
        (-7, 0, "user", "minus"), (-7, 1, "user", "minus"), (0, 0, "u", "😀" * 3), (0, 1, "u", ""), (0, 2, "u", "z"), (105, 0, "u", "no base"), (105, 1, "u", "no base"), (2**60, 5, "1:", "a"),
        (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 0, "u", "w" * 200_000), (6, 0, "u", "w" * 200_000), (300, 0, "q", "r"),
    ]
    for limit in (1, None):
        assert made(spark, rows, limit) == brute(rows)
    turnless = next(c for c in range(1001, 1099) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert made(spark, [(turnless, 0, "u", "gone")]) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_nothing(spark):
    assert made(spark, [(None, 0, "user", "x")]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(T.ordered_turns(empty)).collect() == []


def test_ids_in_pieces(spark, monkeypatch):
    """A node's ids run through many pieces and partitions."""
    rows = spark.range(5000).select((F.col("id") * 17 % 5003).alias("conv_id"), F.lit(bytearray(b"s")).alias("sid"))
    ids = sorted(r["conv_id"] for r in rows.collect())
    assert T._end_digests(rows.repartition(5)).collect()[0]["ends"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
