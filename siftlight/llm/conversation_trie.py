"""Prefix tries of conversations: what turns they share from the start on.

A turn is known by a digest of its role and text; a node is a distinct sequence of the first
turns of some conversations. Conversations that are equal throughout are counted in one
sequence first. Sequences are dealt by their first turn; a subtrie of more turns than a task
should hold is dealt anew by the turn after those that all of it shares, again and again.
What is small enough goes by hash to buckets, whose tries are dictionaries of pointers,
built in applyInPandas and added up from the leaves without recursion. The nodes above are
few: each is a key of sums over the tops of the subtries below it.

Whose conversation ends at a node is told by a digest of all their ids in order: ids are
sorted by range, joined up in pieces, and each node's pieces then stream through one hash.

Defined results: rows with a null conv_id take no part; a null turn comes first, and turns of
equal number stand in the order of their digests; repeated rows are turns of their own; null
role or text is empty; a text of any length is one turn; other columns are ignored; without a
conversation there is no node, not even the root. A conversation's digests stand in one row.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.llm.common import settle, text_or_empty

#: A subtrie of more turns is dealt anew: a 1024th of all, within these bounds.
LEAST, MOST = 1 << 10, 1 << 18
_PIECE = 1 << 20  # characters of ids joined up at a time
_FEW = 1 << 16  # rows of three numbers that are broadcast
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a row per conversation, its turns (key, n_chars) in order."""
    role, text = text_or_empty("role"), text_or_empty("text")
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"), key.alias("key"), F.length(text).cast("long").alias("n_chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return found.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["n_chars"].alias("n_chars"))).alias("turns"))


def with_shared_heads(ordered: DataFrame, of: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % ``of``, all if
    that has fewer and none if it isn't there; h is the CRC of c's digits modulo ``most``."""
    conv = F.col("conv_id")
    heads = ordered.where(conv % of == 0).select(conv.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")
    both = ordered.withColumn("base", conv - conv % of).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _end_digests(rows: DataFrame) -> DataFrame:
    """(sid, ends): the digest of each sid's conv_ids, ascending and joined by commas."""

    def joined(batches):
        now, ids, size = None, [], 0
        for batch in batches:
            for sid, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (sid != now or size > _PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["sid", "first", "ids"])
                    ids, size = [], 0
                now = sid
                ids.append(conv)
                size += 20
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["sid", "first", "ids"])

    def hashed(batches):
        now, state = None, None
        for batch in batches:
            sids, ends = [], []
            for sid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sid == now:
                    state.update(b",")
                else:
                    if state:
                        sids.append(now)
                        ends.append(state.hexdigest())
                    now, state = sid, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(ends, pa.string())], names=["sid", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["sid", "ends"])

    pieces = rows.select("sid", "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(joined, "sid binary, first long, ids string")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").select("sid", "ids").mapInArrow(hashed, "sid binary, ends string")


def _sequences(rebuilt: DataFrame) -> DataFrame:
    """(keys, chars, n, least, ends) of each distinct sequence; ``chars`` begins with the root's 0."""
    sid = F.unhex(F.sha2(F.array_join(F.transform("turns.key", F.hex), "").cast("binary"), 256))
    rows = settle(rebuilt.select("conv_id", "turns", sid.alias("sid")))
    whole = rows.groupBy("sid").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    chars = F.concat(F.array(F.lit(0).cast("long")), F.col("turns.n_chars"))
    return whole.join(_end_digests(rows), "sid").select(F.col("turns.key").alias("keys"), chars.alias("chars"), "n", "least", "ends")


def _shared(low: Column, high: Column) -> Column:
    """How many keys two sequences begin with alike."""
    alike = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(alike, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(low))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= _FEW else rows


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a bucket; ``path`` is null but for their tops."""
    below, above, depths, chars, ns, least, ends, paths, up, tops = [], [], [], [], [], [], [], [], [], {}

    def add(parent: int, depth: int, size: int, path, over) -> int:
        for column, value in ((below, {}), (above, parent), (depths, depth), (chars, size), (ns, 0), (least, None), (ends, _NONE), (paths, path), (up, over)):
            column.append(value)
        return len(below) - 1

    for gid, depth, over, path, keys, sizes, n, first, digest in rows[["gid", "depth", "up", "path", "keys", "chars", "n", "least", "ends"]].itertuples(index=False):
        if gid not in tops:
            tops[gid] = add(-1, int(depth), int(sizes[0]), list(path), over)
        node, at = tops[gid], 0
        while True:
            ns[node] += n
            least[node] = first if least[node] is None else min(least[node], first)
            if at == len(keys):
                break
            key, at = keys[at], at + 1
            if key not in below[node]:
                below[node][key] = add(node, int(depth) + at, int(sizes[at]), None, None)
            node = below[node][key]
        ends[node] = digest
    leaves, saved = [0] * len(below), [(n - 1) * c for n, c in zip(ns, chars)]
    for node in reversed(range(len(below))):  # children come after their parents
        leaves[node] = leaves[node] or 1
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    over = [up[i] if p < 0 else least[p] for i, p in enumerate(above)]
    return pd.DataFrame({
        "conv_id": least, "depth": depths, "parent_conv_id": over, "n_convs": ns, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": ends, "path": paths,
    })


def prefix_trie(rebuilt: DataFrame, limit: int | None = None) -> DataFrame:
    """All nodes of the trie over (conv_id, turns), from the root on: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``limit``: how many turns a subtrie has at most before it is dealt anew."""
    spark = rebuilt.sparkSession
    start = _sequences(rebuilt).withColumns({"gid": F.lit("root"), "depth": F.lit(0), "up": F.lit(None).cast("long"), "path": F.array().cast("array<string>")})
    pending = settle(start)
    total = pending.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _NODE)
    limit = limit or min(MOST, max(LEAST, total // 1024))
    ready, spine, first = [], [], True
    while True:
        sizes = pending.groupBy("gid").agg(F.sum(F.size("keys") - F.col("depth") + 1).alias("turns"), F.count("*").alias("sequences"))
        large = settle(sizes.where(F.lit(first) | ((F.col("turns") > limit) & (F.col("sequences") > 1))).select("gid"))
        n = large.count()
        ready.append(pending.join(_small(large, n), "gid", "left_anti"))
        if not n:
            break
        split = pending.join(_small(large, n), "gid")
        low, high = F.min(F.struct("keys", "chars", "ends")).alias("low"), F.max("keys").alias("high")
        same = [F.first(c).alias(c) for c in ("depth", "up", "path")]
        tops = split.groupBy("gid").agg(low, high, F.sum("n").alias("n"), F.min("least").alias("least"), *same)
        shared = F.lit(0) if first else _shared(F.col("low.keys"), F.col("high"))
        ends = F.when(F.size("low.keys") == F.col("shared"), F.col("low.ends")).otherwise(_NONE)
        chain = F.slice("low.chars", F.col("depth") + 1, F.col("shared") - F.col("depth") + 1)
        tops = settle(tops.withColumn("shared", shared).select("gid", "depth", "up", "path", "shared", chain.alias("chain"), "n", "least", ends.alias("ends")))
        spine.append(tops)
        next_turn = F.sha2(F.concat("gid", F.hex(F.col("keys")[F.col("shared")])).cast("binary"), 256)
        down = split.drop("up", "depth").join(_small(tops.select("gid", "shared", F.col("least").alias("up")), n), "gid").where(F.size("keys") > F.col("shared"))
        pending = settle(down.select(
            next_turn.alias("gid"), (F.col("shared") + 1).alias("depth"), "up", F.concat("path", F.array("gid")).alias("path"), "keys", "chars", "n", "least", "ends",
        ))
        first = False

    buckets = max(4 * spark.sparkContext.defaultParallelism, math.ceil(total / limit))
    rows = _union(ready).select(
        "gid", "depth", "up", "path", F.slice("keys", F.col("depth") + 1, F.size("keys")).alias("keys"), F.slice("chars", F.col("depth") + 1, F.size("chars")).alias("chars"),
        "n", "least", "ends", F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"),
    )
    nodes = settle(rows.groupBy("bucket").applyInPandas(_grown, f"{_NODE}, path array<string>"))
    above = settle(_union(spine))

    own = (F.col("n") - 1) * F.aggregate("chain", F.lit(0).cast("long"), lambda s, x: s + x)
    below = nodes.where(F.col("path").isNotNull()).select("path", "n_leaves", F.col("saved_tokens").alias("saved"))
    with_self = above.select(F.concat("path", F.array("gid")).alias("path"), F.lit(0).cast("long").alias("n_leaves"), own.alias("saved"))
    sums = below.unionByName(with_self).select(F.explode("path").alias("gid"), "n_leaves", "saved").groupBy("gid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    children = below.select("path").unionByName(above.select("path")).where(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("gid")).agg(F.count("*").alias("children"))
    links = above.join(sums, "gid").join(children, "gid", "left")
    links = links.select("*", F.posexplode("chain").alias("at", "size"))
    before = Window.partitionBy("gid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("at") == F.size("chain") - 1
    inner = links.select(
        F.col("least").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.coalesce(F.sum("size").over(before), F.lit(0))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"),
    )
    return inner.unionByName(nodes.drop("path"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
