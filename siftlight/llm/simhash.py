"""SimHash near-duplicate groups, linked through BK-trees.

Fingerprints: over half of the hashes of a text's word shingles set a bit. Links:
fingerprints at ``radius`` or fewer differing bits. Groups: connected components.

Two fingerprints within the radius agree wholly on at least one of ``radius + 1`` bands
of their bits (pigeonhole), so the distinct fingerprints that share a band's value form
a shard. Each shard has a BK-tree, whose children are keyed by their Hamming distance to
the parent; a lookup follows only the edges whose distance differs from the query's by
at most the radius. A shard of more than ``tree`` fingerprints (a large group of near
copies) is salted: it becomes several trees, and each tree is sent to every block of
queries of its shard, so that neither tree nor block outgrows a task. Nothing is
collected to the driver. Lookups report the edges of a spanning forest, never all
pairs. Each task turns its edges into a forest; if a million are left at most, one task
joins them up, otherwise alternating large-star and small-star contraction does.

Defined results: a null or empty text has fingerprint zero and links like any other; a
null ``doc_id`` doesn't become a group's id unless the whole group has none; repeated
rows are kept, each with its group; a text of any length counts whole, its hashes being
summed by blocks; other columns are ignored; empty in, empty out.

``keep_distinct`` goes by the shingles themselves: links are texts whose sets of shingles
are alike by ``least`` or more (Jaccard), and no link between different groups is left out.
First come the links of the BK-trees and those of MinHash: 16 bands of 4 minima, in which
each row is paired with the one before it, so a large group of near copies gives no more
pairs a text than a small one. These, verified, make groups. What they leave apart is joined
by prefixes: in one order of all shingles, that of the common ones last, two sets alike by
``least`` share one of the first n - ceil(least * n) + 1 of each. The first that they share
also bounds how many they can share in all. Pairs that one group holds already aren't asked
for again. A pair whose parities of shingles by bins differ in more places than the sets
may is no link; every other is verified over the whole sets. The common shingles and the
sizes of their cells are those of a sample, which decides on cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import settle, slices, text_or_empty, tidy

_CHUNK = 1 << 16
_TOLD = 1 << 20
_FEW = 1 << 20


def _hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles of ``words`` words, repeats included."""
    import xxhash

    parts = text.encode().lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)] if parts else [], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: len(parts) - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), "<u8", len(starts))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``words`` words, as an unsigned integer."""
    return _majority(_hashes(text, words, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, words: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): a row per document, the fingerprint as a signed 64-bit
    integer. The hash of the text tells apart rows of one id, or of none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for ids, hashes, texts in slices(batches):
            prints = [_signed(fingerprint(t, words)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hashes, prints)], schema=schema)

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text")
    )
    return picked.mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


class BKTree:
    """Fingerprints (unsigned 64-bit) as a tree whose edges carry Hamming distances."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        plain = values.tolist()
        for i in range(1, len(plain)):
            at, x = 0, plain[i]
            while True:
                d = (plain[at] ^ x).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    break
                at = child

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries within the radius of it). All queries go down
        the tree together; an edge is followed by those it can serve."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, active = stack.pop()
            away = np.bitwise_count(queries[active] ^ self.values[node]).astype(np.int64)
            near = active[away <= radius]
            if len(near):
                yield node, near
            for d, child in self.children[node].items():
                serves = active[np.abs(away - d) <= radius]
                if len(serves):
                    stack.append((child, serves))


def _cell_edges(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between a tree and a block of queries
    (None: the tree's own fingerprints)."""
    if len(tree) + (0 if queries is None else len(queries)) < 2 or not len(tree):
        return []
    every = tree if queries is None else np.concatenate([queries, tree])
    first = 0 if queries is None else len(queries)
    asked = tree if queries is None else queries
    label, out = np.arange(len(every)), []
    for node, near in BKTree(tree).within(asked, radius):
        own = label[first + node]
        for other in np.unique(label[near]).tolist():
            if other != own:
                i = near[label[near] == other][0]
                out.append((int(every[first + node]), int(every[i])))
                label[label == other] = own
    return out


def _edges_of_cells(batches, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, and within it the queries before the tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    cell, held = None, []

    def close() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        fp = np.array([x[0] for x in held], dtype=np.int64).view(np.uint64)
        role = np.array([x[1] for x in held])
        own = role == 2  # both tree and queries
        if own.any():
            return _cell_edges(fp, None, radius)
        return _cell_edges(fp[role == 1], fp[role == 0], radius)

    out: list[tuple[int, int]] = []
    for batch in batches:
        for key, i, j, role, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, i, j) != cell:
                out += close()
                cell, held = (key, i, j), []
            held.append((fp, role))
        if len(out) >= 4096:
            yield _edge_batch(out, schema)
            out = []
    out += close()
    yield _edge_batch(out, schema)


def _edge_batch(edges, schema) -> pa.RecordBatch:
    ends = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)


def links(distinct: DataFrame, radius: int = 3, tree: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same groups as all
    links do. ``distinct`` has them in ``fp``, each once."""
    bands = radius + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    keys = [
        F.struct(
            F.lit(i).alias("band"),
            F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 63 else -1)).alias("value"),
        )
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select(
        "fp", F.xxhash64("k.band", "k.value").alias("key")
    )
    hot = keyed.groupBy("key").count().where(F.col("count") > tree).select("key", F.ceil(F.col("count") / tree).cast("int").alias("trees"))
    salted = keyed.join(hot, "key", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(7)), "trees").cast("int"))
    cells = F.when(
        F.col("trees") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("trees") - 1),
            lambda t: F.when(t < F.col("salt"), F.struct(t.alias("i"), F.col("salt").alias("j"), F.lit(1).alias("role")))
            .when(t > F.col("salt"), F.struct(F.col("salt").alias("i"), t.alias("j"), F.lit(0).alias("role")))
            .otherwise(F.struct(t.alias("i"), t.alias("j"), F.lit(2).alias("role"))),
        )
    )
    dealt = salted.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "c.role", "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return dealt.mapInArrow(tidy(lambda batches: _edges_of_cells(batches, radius)), "a long, b long")


def _join_salted(many: DataFrame, one: DataFrame, key: str, by: Column, total: int, salts: int = 64) -> DataFrame:
    """The rows of ``many`` with the row of ``one`` of their key. ``one`` counts in ``n``
    how many rows of ``many`` each key has, ``total`` is at least their sum. Keys of over a
    1024th of it, so fewer than 1024, are told to all tasks, and their rows salted by ``by``."""
    hot = F.col("n") * 1024 > total
    told = F.broadcast(one.where(hot).select(key, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = many.join(told, key, "left").withColumn("salt", salt).drop("hot")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("salt", F.explode(every)).drop("n"), [key, "salt"]).drop("salt")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def _row() -> Column:
    """What tells apart most rows of a checkpointed table, even copies without an id."""
    return F.struct("doc_id", "text_hash", F.spark_partition_id())


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest nodes that these edges reach from them, without those that are
    the smallest themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _forests(batches, few: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from each node to the smallest it reaches. A forest of over ``few`` edges is
    let go, so that no task holds many; ``few`` edges or less give one forest."""
    a, b, n = [], [], 0

    def close() -> tuple[np.ndarray, np.ndarray]:
        return _contract(np.concatenate(a), np.concatenate(b))

    for batch in batches:
        for column, held in zip("ab", (a, b)):
            held.append(batch.column(column).to_numpy())
        n += batch.num_rows
        if n > 2 * few:
            x, y = close()
            a, b, n = [x], [y], len(x)
            if n > few:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                a, b, n = [], [], 0
    if n:
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def components(edges: DataFrame, few: int = _FEW) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge that isn't
    itself the smallest. Each task contracts its own edges. What is left is contracted by one
    task if it is ``few`` edges at most, so bounded. Otherwise large-star and small-star
    alternate until nothing changes; each round is checkpointed, and a node of very many
    edges is salted."""
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    def lows(df):
        return df.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))

    run = tidy(lambda batches: _forests(batches, _FEW))
    own = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(run, "a long, b long"))
    if own.count() <= few:
        return settle(own.coalesce(1).mapInArrow(run, "a long, b long")).toDF("node", "root")
    now = settle(own.distinct())
    seen = state(now)
    while seen[0]:
        both, total = now.union(now.select("b", "a")), 2 * seen[0]
        near = _join_salted(both, lows(both), "a", F.col("b"), total).where("b > a")
        large = near.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        small = _join_salted(large, lows(large), "a", F.col("b"), total).select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = settle(small)
        if (then := state(now)) == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, words: int, radius: int, tree: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every document."""
    prints = settle(fingerprints(docs, words, id_col=id_col, text_col=text_col))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = components(settle(links(nodes.select("fp"), radius, tree)))
    rooted = settle(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = _join_salted(rooted.select("fp", "root", F.col("n").alias("rows")), named, "root", F.col("fp"), total)
    return _join_salted(prints, named.withColumnRenamed("rows", "n"), "fp", _row(), total)


def near_duplicates(
    docs: DataFrame, *, words: int = 3, radius: int = 3, tree: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per document: doc_id, its fingerprint (16 hex digits) and component_id, the
    smallest id among the documents reachable over links."""
    return _grouped(docs, words, radius, tree, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


_BANDS, _ROWS = 16, 4


def _band_keys(shingles: np.ndarray) -> list[int]:
    """Keys of the bands of minima of a set of shingles."""
    rng = np.random.default_rng(9)
    turns = rng.integers(0, 1 << 63, (2, _BANDS * _ROWS, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    least = np.full(_BANDS * _ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        mixed = (shingles[None, at : at + 2048] ^ turns[0]) * turns[1]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    keys = np.zeros(_BANDS, dtype=np.uint64)
    for column in least.reshape(_BANDS, _ROWS).T:
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist()


def _node(text: str) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split())))


def _parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of a set of shingles is in each bin, by their low bits. There are
    as many bins as shingles or up to twice as many, a power of two, and 512 at least."""
    bins = max(512, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bins_apart(x: bytes, y: bytes) -> int:
    """In how many bins two sets differ: they differ in at least as many shingles."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(p) < len(q):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _signed_texts(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, node, fp, keys, size, bins): ``node`` is one for texts of the same
    words, ``size`` the number of different shingles."""
    schema = pa.schema([*((x, pa.int64()) for x in ("doc_id", "text_hash", "node", "fp")), ("keys", pa.list_(pa.int64())), ("size", pa.int64()), ("bins", pa.binary())])

    def run(batches):
        for ids, hashes, texts in slices(batches):
            nodes, prints, keys, sizes, bins = [], [], [], [], []
            for t in texts:
                shingles = _hashes(t, words)
                unique = np.unique(shingles)
                nodes.append(_node(t))
                prints.append(_signed(_majority(shingles)))
                keys.append(_band_keys(unique) if len(shingles) > 1 else [])
                sizes.append(len(unique))
                bins.append(_parities(unique))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, hashes, nodes, prints, keys, sizes, bins), schema.types)], schema=schema)

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text")
    )
    return picked.mapInArrow(tidy(run), "doc_id long, text_hash long, node long, fp long, keys array<long>, size long, bins binary")


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of a row and the one before it of the same key."""
    last_key, last = None, None
    for batch in batches:
        a, b = [], []
        for key, node in zip(*(batch.column(c).to_pylist() for c in ("key", "node"))):
            if key == last_key:
                a.append(max(node, last))
                b.append(min(node, last))
            last_key, last = key, node
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes that are next to each other in a band."""
    keyed = nodes.select("node", "keys", F.posexplode("keys").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("key"), F.get("keys", (F.col("band") + 1) % _BANDS).alias("turn"), "node"
    )
    keyed = keyed.repartitionByRange("key", "turn", "node").sortWithinPartitions("key", "turn", "node")
    return keyed.mapInArrow(tidy(_neighbours), "a long, b long")


@dataclass
class Common:
    """Shingles that many texts have, ascending; in how many texts of a sample; into how many
    trees their cells are split."""

    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, "<u8"))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    trees: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def places(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each shingle stands here, and whether it does."""
        if not len(self.shingles):
            return np.zeros(len(shingles), np.int64), np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return at, self.shingles[at] == shingles


def _prefix(shingles: np.ndarray, common: Common, least: float) -> np.ndarray:
    """The first of a set (ascending) by the order of all shingles: so many that another set
    alike by ``least`` has one of them among its own."""
    at, known = common.places(shingles)
    if known.any():
        shingles = shingles[np.argsort(np.where(known, common.counts[at], 0), kind="stable")]
    return shingles[: len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1]


def _postings(shingles: np.ndarray, node: int, common: Common, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a set, and for each its size, the place of the shingle and the side in
    the cell (2: both sides) as one integer."""
    cells = _prefix(shingles, common, least)
    meta = np.int64(len(shingles)) << 33 | np.arange(len(cells), dtype=np.int64) << 2
    at, known = common.places(cells)
    split = np.nonzero(known & (common.trees[at] > 1))[0] if known.any() else []
    if not len(split):
        return cells.view(np.int64), meta | 2
    whole = np.ones(len(cells), bool)
    whole[split] = False
    all_cells, all_meta = [cells[whole]], [meta[whole] | 2]
    for i in split.tolist():
        trees = int(common.trees[at[i]])
        own, other = node % trees, np.arange(trees)
        block = np.minimum(own, other) * trees + np.maximum(own, other) + 1
        all_cells.append(cells[i] + block.astype("<u8") * np.uint64(0x9E3779B97F4A7C15))
        all_meta.append(meta[i] | np.where(other == own, 2, (other < own).astype(np.int64)))
    return np.concatenate(all_cells).view(np.int64), np.concatenate(all_meta)


def _common(docs: DataFrame, words: int, least: float, tree: int, text_col: str, sample: int = 4096, most: int = 1 << 14) -> Common:
    """The shingles of three or more of a sample of about ``sample`` texts, ``most`` at most.
    They only order shingles and split cells: any others would give the same links."""
    every = max(1, docs.count() // sample)

    def read(batches):
        for (texts,) in slices(batches):
            sets = [pa.array(np.unique(_hashes(t, words)).view(np.int64)) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([_node(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["node", "shingles"])

    text = text_or_empty(text_col)
    picked = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    sets = settle(picked.mapInArrow(tidy(read), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")))
    counted = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    if not len(rows):
        return Common()
    found = rows.column("shingle").to_numpy().view("<u8")
    order = np.argsort(found)
    common = Common(found[order], rows.column("count").to_numpy()[order], np.ones(len(rows), np.int64))

    def first(batches):
        for batch in batches:
            heads = [_prefix(np.array(x, np.int64).view("<u8"), common, least) for x in batch.column("shingles").to_pylist()]
            heads = np.concatenate(heads) if heads else np.zeros(0, "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(heads[common.places(heads)[1]].view(np.int64))], names=["shingle"])

    for r in sets.mapInArrow(tidy(first), "shingle long").groupBy("shingle").count().where(F.col("count") * every > tree).collect():
        at = np.searchsorted(common.shingles, np.array([r["shingle"]], np.int64).view("<u8"))[0]
        common.trees[at] = -(-r["count"] * every // tree)
    return common


def _cell_pairs(batches, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of a cell that different groups hold and that, if the cell's shingle is the
    first that both have, can be alike by ``least``. Rows come sorted by cell."""
    share = least / (1 + least)

    def pairs(cell, node, root, meta) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.nonzero(cell[1:] != cell[:-1])[0] + 1))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep = np.repeat(mixed, np.diff(np.append(starts, len(cell))))
        cell, node, root, meta = cell[keep], node[keep], root[keep], meta[keep]
        size, side = meta >> 33, meta & 3
        rest = size - (meta >> 2 & (1 << 31) - 1)
        i, ahead, a, b, held = np.arange(len(cell)), 1, [], [], 0
        while len(i := i[: np.searchsorted(i, len(cell) - ahead)]) and len(i := i[cell[i] == cell[i + ahead]]):
            j = i + ahead
            good = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 2))
            good &= np.minimum(rest[i], rest[j]) >= share * (size[i] + size[j]) - 1e-9
            x, y = node[i[good]], node[j[good]]
            a.append(np.maximum(x, y))
            b.append(np.minimum(x, y))
            held, ahead = held + len(x), ahead + 1
            if held > _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[list[np.ndarray]] = []  # of the last cell, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("cell", "node", "root", "meta")]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or held and held[0][0][0] != columns[0][0]:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])))
            held = []
        held.append([c[cut:].copy() for c in columns])
    if held:
        yield from pairs(*(np.concatenate(x) for x in zip(*held)))


def _prefix_pairs(docs: DataFrame, roots: DataFrame, common: Common, words: int, least: float, text_col: str) -> DataFrame:
    """(a, b): all nodes of different ``roots`` that can be alike by ``least``, some of them
    more than once."""

    def run(batches):
        for (texts,) in slices(batches):
            nodes, ends, cells, meta = [], [0], [], []
            for t in texts:
                shingles = np.unique(_hashes(t, words))
                if not len(shingles):
                    continue
                nodes.append(_node(t))
                its, about = _postings(shingles, nodes[-1], common, least)
                cells.append(its)
                meta.append(about)
                ends.append(ends[-1] + len(its))
            if nodes:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (cells, meta)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *lists], names=["node", "cell", "meta"])

    posted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), "node long, cell array<long>, meta array<long>")
    posted = posted.groupBy("node").agg(F.first("cell").alias("cell"), F.first("meta").alias("meta")).join(roots, "node", "left")
    posted = posted.select("node", F.coalesce("root", "node").alias("root"), F.explode(F.arrays_zip("cell", "meta")).alias("c")).select("c.cell", "node", "root", "c.meta")
    return posted.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(lambda batches: _cell_pairs(batches, least)), "a long, b long")


def _tree_links(nodes: DataFrame, radius: int, tree: int) -> DataFrame:
    """(a, b): the nodes that BK-trees link, one for each fingerprint, and that one with the
    others of its fingerprint."""
    prints = settle(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    ends = F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")
    found = links(prints.select("fp"), radius, tree)
    found = found.join(prints.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    same = nodes.join(prints, "fp").select(F.col("node").alias("x"), F.col("one").alias("y")).where("x <> y")
    return found.select(*ends).unionByName(same.select(*ends))


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """The ``pairs`` whose texts are alike by ``least``. ``nodes`` has in ``k`` the id and the
    text's hash of one row of each node, which gives the text."""
    about = nodes.select("node", "size", "bins")
    for end in "ab":
        pairs = pairs.join(about.toDF(end, f"size_{end}", f"bins_{end}"), end)
    pairs = pairs.where(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9)

    def possible(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("size_a", "bins_a", "size_b", "bins_b"))
            good = [_bins_apart(x, y) <= (1 - least) / (1 + least) * (m + n) + 1e-9 for m, x, n, y in zip(*columns)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    pairs = settle(pairs.mapInArrow(tidy(possible), "a long, b long"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = nodes.join(asked, "node", "left_semi").select("node", "k.doc_id", "k.text_hash")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    picked = picked.withColumn("text_hash", F.xxhash64("text"))
    # Few hashes are told to the texts, so that only those asked for are shuffled.
    hashes = settle(chosen.select("text_hash").distinct())
    if hashes.count() <= _TOLD:
        picked = picked.join(F.broadcast(hashes), "text_hash", "left_semi")
    same = picked.doc_id.eqNullSafe(chosen.doc_id) & (picked.text_hash == chosen.text_hash)
    texts = settle(picked.join(chosen, same).select("node", "text").dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def verify(batches):
        for ends_a, ends_b, texts_a, texts_b in slices(batches):
            good = []
            for a, b, x, y in zip(ends_a, ends_b, texts_a, texts_b):
                p, q = np.unique(_hashes(x, words)), np.unique(_hashes(y, words))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= least * (len(p) + len(q) - common):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in good], pa.int64()) for i in range(2)], names=["a", "b"])

    return settle(both.mapInArrow(tidy(verify), "a long, b long"))


def keep_distinct(
    docs: DataFrame, *, words: int = 5, least: float = 0.8, radius: int = 3, tree: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without all but one row of each group of texts whose shingles of ``words``
    words are alike by ``least`` or more; the row kept is that of ``keep_one``."""
    signed = settle(_signed_texts(docs, words, id_col, text_col))
    firsts = [F.first(c).alias(c) for c in ("keys", "fp", "size", "bins")]
    nodes = settle(signed.groupBy("node").agg(*firsts, F.min(_order()).alias("k"), F.count("*").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    pairs = settle(_candidates(nodes).unionByName(_tree_links(nodes, radius, tree)).distinct())
    near = components(_alike(pairs, nodes, docs, words, least, id_col, text_col))
    more = settle(_prefix_pairs(docs, near, _common(docs, words, least, tree, text_col), words, least, text_col).distinct().join(pairs, ["a", "b"], "left_anti"))
    joined = _alike(more, nodes, docs, words, least, id_col, text_col)
    roots = components(near.toDF("a", "b").unionByName(joined))
    rooted = nodes.select("node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = _join_salted(signed.drop("keys", "fp", "size", "bins"), rooted, "node", _row(), total).select("doc_id", "text_hash", "root")
    return _keep_best(docs, grouped, id_col, text_col)


def keep_one(
    docs: DataFrame, *, words: int = 3, radius: int = 3, tree: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without all but one row of each group: the one of the smallest id, of
    equal ids that of the smallest text hash; rows without an id come last. Of rows that
    agree in both, one whose text isn't null, and the first by its columns as JSON, stays."""
    return _keep_best(docs, _grouped(docs, words, radius, tree, id_col, text_col), id_col, text_col)


def _keep_best(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each group of ``grouped`` (doc_id, text_hash, root)."""
    best = grouped.groupBy("root").agg(F.min(_order()).alias("k")).select("k.doc_id", "k.text_hash")
    # Rows that agree in id and text are copies of one row: how many there are decides whether any must be dropped.
    best = settle(grouped.join(best, grouped.doc_id.eqNullSafe(best.doc_id) & (grouped.text_hash == best.text_hash), "left_semi")
                  .groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")))
    # The rows go as one column each, so that their columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    same = rows.doc_id.eqNullSafe(best.doc_id) & (rows.text_hash == best.text_hash)
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if best.where("copies > 1").isEmpty():
        return rows.join(best, same, "left_semi").select(*columns)
    kept = rows.join(best, same).select("row", best.doc_id, best.text_hash, "copies")
    first = F.min_by("row", F.struct(F.col(f"row.`{text_col}`").isNull(), F.to_json("row")))
    several = kept.where("copies > 1").groupBy("doc_id", "text_hash").agg(first.alias("row"))
    return kept.where("copies = 1").select("row").unionByName(several.select("row")).select(*columns)
