"""A uniform shuffle into shards of exact sizes through a communication matrix.

The rows of each input partition are to be dealt to the shards. How many go from which
partition to which shard is drawn first, from the multivariate hypergeometric
distribution with the partitions' counts as row sums and the shards' exact sizes as
column sums: the counts that a uniform permutation of all rows would have. Then every
partition permutes its rows and cuts them by its row of the matrix, the cuts are
exchanged, and every shard permutes what it got. Data moves only as narrow rows (id,
size, checksum), in DataFrame operations; the driver sees one count per partition.

Shards may hold far more than a task should sort. The second permutation therefore goes
by a random key whose leading part deals a shard's rows to buckets; the buckets' counts
give each its first slot. All random keys are hashes of the row's number and a seed, over
a checkpointed table, so a task that is run again repeats them exactly.

Law: ``rows`` (shards' row counts differ by one at most). Defined results: a null text
has no bytes (size 1) and the checksum of an empty one; null ids and repeated rows are
rows like others; other columns are ignored; an empty table gives empty shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftlight.llm.common import settle

#: Up to so many partitions the matrix (a few bytes per shard) is broadcast; beyond, joined.
_BROADCAST_PARTITIONS = 20_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. numpy draws from populations
    below 1e9; beyond, the distribution is inverted around its mode, as far as it has
    weight in double precision."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    spread = (n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5
    width = int(12 * spread) + 50
    x = np.arange(max(low, mode - width), min(high, mode + width) + 1, dtype=np.float64)
    # log of p(x + 1) / p(x)
    steps = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - n + x[:-1] + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.cumsum(np.exp(logs - logs.max()))
    return int(x[int(np.searchsorted(p, rng.random() * p[-1], side="right"))])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """One draw, partitions by shards, with the given row and column sums: each row is
    multivariate hypergeometric from what the rows before have left."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes must have one sum")
    rng = np.random.default_rng(seed)
    left, out = list(sizes), np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest = sum(left)
        for j, size in enumerate(left):
            rest -= size
            out[i, j] = _hypergeometric(rng, size, rest, n) if n else 0
            n -= int(out[i, j])
            left[j] = size - int(out[i, j])
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _random(seed: int, turn: int) -> Column:
    return F.xxhash64(F.col("row"), F.lit(seed), F.lit(turn))


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, *, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: a row's place in its shard, from 0."""
    text = F.col(text_col)
    narrow = settle(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    # A row's number has its partition in the leading bits.
    rows = narrow.withColumn("part", F.shiftright("row", 33).cast("int"))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator()}
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, shards), seed)
    cuts = docs.sparkSession.createDataFrame(
        [(p, np.cumsum(line).tolist()) for p, line in zip(parts, matrix)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType()))]),
    )
    if len(parts) <= _BROADCAST_PARTITIONS:
        cuts = F.broadcast(cuts)
    local = F.row_number().over(Window.partitionBy("part").orderBy(_random(seed, 1), "row")) - 1
    dealt = rows.withColumn("place", local).join(cuts, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("place"))))
    buckets = max(1, total // shards // bucket_rows)
    key = _random(seed, 2)
    dealt = dealt.select("doc_id", "size", "text_crc32", "row", "shard", key.alias("key"))
    # The key's high bits, as a number from 0 to buckets - 1 in the key's order.
    high = F.shiftrightunsigned(F.col("key"), 33)
    dealt = settle(dealt.withColumn("bucket", F.floor(high * buckets / F.lit(1 << 31)).cast("int")))
    filled = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    firsts = filled.select("shard", "bucket", before.alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.shiftrightunsigned("key", 1), "row")) - 1
    placed = dealt.withColumn("within", within).join(firsts, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
