"""Nearest vectors: exact, and by inverted lists (IVF)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.functions.vectors import dot, literal, norm
from siftlight.operators.lexical import top
from siftlight.sources.tables import dealt, settle


def check_dim(vectors: DataFrame, query, embedding: str = "embedding") -> None:
    """Raises ValueError if the query and the stored vectors differ in dimension."""
    row = vectors.select(F.size(embedding).alias("d")).where("d > 0").first()
    if row is not None and row["d"] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the table {row['d']}")


def _sound(embedding: str, dim: int) -> Column:
    """The vector, in doubles; zeros for a null one, one of another dimension or with nulls in it."""
    zero = F.array_repeat(F.lit(0.0), dim)
    v = F.col(embedding).cast("array<double>")
    return F.coalesce(F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v), zero)


def cosine_scores(vectors: DataFrame, query, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, score) of every vector. Zero vectors score zero, and so do rows without a vector
    of the query's dimension or with nulls in it."""
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    length = norm(F.col(embedding)) * size
    score = dot(F.col(embedding), literal(query)) / length
    sound = (F.size(embedding) == len(query)) & (length > 0)
    return vectors.select(F.col(id_col).alias("id"), F.coalesce(F.when(sound, score), F.lit(0.0)).alias("score"))


def exact(vectors: DataFrame, query, k: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest by cosine: a scan and a heap per partition."""
    check_dim(vectors, query, embedding)
    return top(cosine_scores(vectors, query, id_col, embedding), k)


_QUERIES, _ROWS, _CELLS, _LISTED = 4096, 1024, 1 << 22, 1 << 17
#: Bytes of queries that a scan holds, with what it must know of them.
_ROOM = 64 << 20
#: Scores are rounded to six digits, so that one this much below another may equal it.
_HALF = 1e-6
#: Vectors whose neighbours tell how many lists a search of an index needs.
ASKED = 200


class _Best:
    """The k best of each query so far, by score, then id; ids are integers or texts."""

    def __init__(self, n: int, k: int, ids: np.dtype):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max) if ids.kind == "i" else np.full((n, k), "", dtype=ids)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``, not rounded: a row for each of the queries ``which``, a column for each id."""
        # Only what reaches a query's k-th score is sorted, ties and all.
        least = self.scores[which, -1]
        if scores.shape[1] > self.k and not np.isfinite(least).all():
            new = ~np.isfinite(least)
            least[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
        row, column = np.nonzero(scores >= (least - _HALF)[:, None])
        if not len(row):
            return
        if ids.dtype.kind == "U":  # room for the longest text
            self.ids = self.ids.astype(np.promote_types(ids.dtype, self.ids.dtype), copy=False)
        some = np.unique(row)
        held = which[some]
        rows = np.concatenate([np.repeat(some, self.k), row])
        values = np.concatenate([self.scores[held].ravel(), np.round(scores[row, column], 6)])
        names = np.concatenate([self.ids[held].ravel(), ids[column]])
        order = np.lexsort((names, -values, rows))
        # Each row has k or more, for it had k before.
        starts = np.searchsorted(rows[order], some)
        picked = order[starts[:, None] + np.arange(self.k)]
        self.scores[held], self.ids[held] = values[picked], names[picked]


def _names(ids) -> np.ndarray:
    return np.array(ids.to_pylist(), dtype=str) if ids.type == "string" else ids.to_numpy(zero_copy_only=False)


def _packed_queries(queries: DataFrame, dim: int, room: int) -> DataFrame:
    """(block, names, asked[, lists]): so many queries in a row that they take ``room`` bytes at most."""
    import pyarrow as pa

    kind, most = queries.schema["query_id"].dataType.simpleString(), max(1, min(_QUERIES, room // (8 * dim)))
    lists = ["lists"] if "lists" in queries.columns else []

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                asked = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
                asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                wide = [pa.array([x.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], pa.binary()) for x in part.columns[2:]]
                yield pa.RecordBatch.from_arrays([one(part.column(0)), pa.array([asked.tobytes()], pa.binary()), *wide], names=["names", "asked", *lists])

    rows = queries.select("query_id", _sound("vector", dim).alias("vector"), *lists)
    # Numbered once, as written.
    return settle(rows.mapInArrow(run, f"names array<{kind}>, asked binary" + ", lists binary" * len(lists)).withColumn("block", F.monotonically_increasing_id()))


def _scan(rows: DataFrame, queries: DataFrame, k: int, dim: int, block: int, room: int) -> DataFrame:
    """(query_id, id, score, rank) over ``rows`` (id, v[, list]). Queries are packed where
    they lie; as many as fit in ``room`` are sent to all tasks, and for these the rows are
    scanned once, each row being sent to Python once. Each task keeps its k best of each
    query. With lists, a query is held only against the rows of those it names."""
    import pyarrow as pa
    from pyspark.sql.window import Window

    kind, id_kind = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    lists, spark = "list" in rows.columns, rows.sparkSession
    blocks = _packed_queries(queries, dim, room)
    # Each task sends its best of all queries: no more tasks than twice the cores.
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)

    def scan(held):
        def run(batches):
            asked, named, best = held.value[0], held.value[1], None
            order = starts = None
            if lists:
                # Queries by the lists that they name.
                order = np.argsort(named, axis=None, kind="stable")
                starts = np.searchsorted(named.ravel()[order], np.arange(int(named.max(initial=-1)) + 2))
                order //= max(1, named.shape[1])
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(at, _ROWS)
                    ids = _names(part.column(0))
                    own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)
                    best = best or _Best(len(asked), k, ids.dtype)
                    groups = [(np.arange(len(asked)), np.arange(len(ids)))]
                    if lists:
                        which = part.column(2).to_numpy(zero_copy_only=False)
                        groups = [(order[starts[x] : starts[x + 1]], np.flatnonzero(which == x)) for x in np.unique(which).tolist() if x + 1 < len(starts)]
                    for asking, there in groups:
                        for first in range(0, len(asking), block):
                            some = asking[first : first + block]
                            best.add(some, asked[some] @ own[there].T, ids[there])
            if best is None:
                return
            q, place = np.nonzero(np.isfinite(best.scores))
            names = held.value[2]
            for at in range(0, len(q), 65_536):
                a, b = q[at : at + 65_536], place[at : at + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(names[a], names_type), pa.array(best.ids[a, b]), pa.array(best.scores[a, b] + 0.0)], names=["query_id", "id", "score"])

        return rows.select("id", "v", *(["list"] if lists else [])).mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")

    names_type, parts, group, left = pa.string() if kind == "string" else None, [], [], room

    def sent():
        found = blocks.where(F.col("block").isin(group)).toArrow()
        asked = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, dim) for x in found["asked"]])
        named = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in found["lists"]]).reshape(len(asked), -1) if lists else None
        names = np.concatenate([np.asarray(x.values.to_pylist() if kind == "string" else x.values.to_numpy(zero_copy_only=False)) for x in found["names"]])
        return spark.sparkContext.broadcast((asked, named, names))

    sized = blocks.select("block", (F.length("asked") + (F.length("lists") if lists else F.lit(0))).alias("size")).collect()  # a row for some thousand queries
    for i, r in enumerate(sized):
        group.append(r["block"])
        left -= r["size"]
        # What goes with the next one is over the room, or there is none.
        if i + 1 < len(sized) and sized[i + 1]["size"] <= left:
            continue
        parts.append(scan(sent()))
        group, left = [], room
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, id {id_kind}, score double, rank long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _dim(vectors: DataFrame, embedding: str) -> int:
    row = vectors.select(F.size(embedding).alias("d")).where("d > 0").first()
    return row["d"] if row else 1


def exact_many(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", block: int = 256, room: int = _ROOM
) -> DataFrame:
    """(query_id, id, score, rank) for a table of queries (query_id, vector). They are sent
    to all tasks, as many at a time as take ``room`` bytes, for each of which the vectors are
    scanned once; numpy compares ``block`` of them at a time. Ids are integers or texts.
    Vectors and queries that ``cosine_scores`` would call unsound count as zero."""
    if k < 1:
        raise ValueError("k must be at least 1")
    dim = _dim(vectors, embedding)
    return _scan(vectors.select(_id(vectors, id_col), _sound(embedding, dim).alias("v")), queries, k, dim, block, room)


def _id(vectors: DataFrame, id_col: str) -> Column:
    return F.col(id_col).cast("string" if vectors.schema[id_col].dataType.simpleString() == "string" else "long").alias("id")


def _lloyd(v: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of some vectors in numpy; centres without vectors stay where they began."""
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(v, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(v: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each vector, in order."""
    k, out = min(k, len(centres)), np.empty((len(v), min(k, len(centres))), dtype=np.int32)
    size, step = (centres**2).sum(axis=1), max(1, _CELLS // len(centres))
    for at in range(0, len(v), step):
        away = size - 2 * (v[at : at + step] @ centres.T)
        near = np.argpartition(away, k - 1, axis=1)[:, :k]
        order = np.lexsort((near, np.take_along_axis(away, near, axis=1)), axis=1)
        out[at : at + step] = np.take_along_axis(near, order, axis=1)
    return out


class IvfIndex:
    """Inverted lists under a tree of centres, which is fit on a sample of at most ``sample``
    vectors: k-means parts it in the root of ``lists`` cells, and each cell, on the executors,
    in its share of the lists. Every vector is in the list of its nearest centre. There are
    about as many lists as a list has vectors, if no number is given. A search compares the
    lists nearest to the query, by default as many as held 0.95 of the ten nearest of
    ``ASKED`` stored vectors when the index was made. Centres are an array that tasks share:
    no plan grows with the lists.

    ``table``: the vectors with their ``list``; ``centres``: a row per list; ``sizes``: how
    many vectors each has; ``probe``: that number of lists."""

    def __init__(self, table: DataFrame, centres: np.ndarray, sizes: dict[int, int], probe: int, id_col: str, embedding: str):
        self.table, self.centres, self.sizes, self.probe, self.id_col, self.embedding = table, centres, sizes, probe, id_col, embedding

    @classmethod
    def create(cls, vectors: DataFrame, root: str, lists: int | None = None, id_col: str = "vec_id", embedding: str = "embedding", sample: int = 100_000, seed: int = 42) -> IvfIndex:
        """Fits the centres, writes the lists in their order below ``root``, so that a search skips
        the row groups of others, and reads them."""
        import pyarrow as pa
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark, n, dim = vectors.sparkSession, vectors.count(), _dim(vectors, embedding)
        lists = lists or max(1, min(65_536, round(math.sqrt(n))))
        share = min(1.0, sample / max(1, n))
        picked = F.lit(True) if share == 1.0 else F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
        seen = settle(vectors.where(picked).select(_sound(embedding, dim).alias("v")).withColumn("f", array_to_vector("v")))
        cells = max(2, round(math.sqrt(lists)))
        model = KMeans(k=cells, seed=seed, featuresCol="f", predictionCol="cell", maxIter=20).fit(seen.select("f"))
        each = math.ceil(lists / cells)

        def parted(key, group):
            v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), dim)
            return pa.table({"cell": pa.array([key[0].as_py()] * min(each, len(v)), pa.int32()), "centre": pa.array(list(_lloyd(v, each, 10, seed)), pa.list_(pa.float64()))})

        # A row per list, at most 65,536 by default.
        found = model.transform(seen).select("cell", "v").groupBy("cell").applyInArrow(parted, "cell int, centre array<double>").orderBy("cell", "centre").select("centre").toArrow()
        centres = found["centre"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((1, dim))
        held, kind = spark.sparkContext.broadcast(centres), vectors.schema[id_col].dataType.simpleString()

        def listed(batches):
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest(v, held.value, 1)[:, 0])], names=["id", "list"])

        where = vectors.select(F.col(id_col).alias("id"), _sound(embedding, dim).alias("v")).mapInArrow(listed, f"id {kind}, list int")
        # A list of very many vectors is written by several tasks.
        dealt_out = dealt(settle(where), ["list"], _LISTED).withColumnRenamed("id", id_col)
        vectors.join(dealt_out, id_col).repartitionByRange("list", "part").sortWithinPartitions("list").drop("part").write.parquet(f"{root}/lists")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{root}/centres")
        made = cls(spark.read.parquet(f"{root}/lists"), centres, {}, 0, id_col, embedding)
        spark.createDataFrame([(made._enough(seed),)], "probe int").coalesce(1).write.parquet(f"{root}/probe")
        held.destroy()
        return cls.read(spark, root, id_col, embedding)

    def _enough(self, seed: int, k: int = 10, share: float = 0.95) -> int:
        """How many lists hold that share of the k nearest of some stored vectors."""
        dim = self.centres.shape[1]
        rows = self.table.select(F.xxhash64(self.id_col).alias("vec_id"), _sound(self.embedding, dim).alias("embedding"), "list")
        asked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).persist()
        truth = exact_many(rows, asked, k).select("query_id", F.col("id").alias("vec_id"))
        vectors = {r["query_id"]: r["vector"] for r in asked.collect()}
        order = {q: {x: i for i, x in enumerate(self._near(v), 1)} for q, v in vectors.items()}
        # ASKED times k rows.
        places = [order[r["query_id"]][r["list"]] for r in rows.join(F.broadcast(truth), "vec_id").select("query_id", "list").collect()]
        asked.unpersist()
        return int(np.quantile(places, share, method="higher")) if places else 1

    @classmethod
    def read(cls, spark, root: str, id_col: str = "vec_id", embedding: str = "embedding") -> IvfIndex:
        table = spark.read.parquet(f"{root}/lists")
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{root}/centres").orderBy("list").collect()])
        sizes = {r["list"]: r["count"] for r in table.groupBy("list").count().collect()}
        return cls(table, centres, sizes, spark.read.parquet(f"{root}/probe").first()["probe"], id_col, embedding)

    def _near(self, query) -> list[int]:
        return np.argsort(((self.centres - np.array(query, dtype=np.float64)) ** 2).sum(axis=1), kind="stable").tolist()

    def search(self, query, k: int, probe: int | None = None, ef: int | None = None) -> DataFrame:
        """The k best of the nearest ``probe`` lists, or of as many as hold ``ef`` vectors."""
        near = self._near(query)
        if ef is not None:
            held = np.cumsum([self.sizes.get(x, 0) for x in near])
            probe = 1 + int(np.searchsorted(held, max(k, ef)))
        picked = near[: probe or self.probe]
        return top(cosine_scores(self.table.where(F.col("list").isin(picked)), query, self.id_col, self.embedding), k)

    def search_many(self, queries: DataFrame, k: int, probe: int | None = None, block: int = 256, room: int = _ROOM) -> DataFrame:
        """(query_id, id, score, rank) for a table of queries (query_id, vector): one scan
        of the lists for as many queries as fit in ``room``."""
        import pyarrow as pa

        dim, probe = self.centres.shape[1], min(probe or self.probe, len(self.centres))
        kind, held = queries.schema["query_id"].dataType.simpleString(), self.table.sparkSession.sparkContext.broadcast(self.centres)

        def led(batches):
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                near = nearest(v, held.value, probe)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probe, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["query_id", "vector", "lists"])

        asked = queries.select("query_id", _sound("vector", dim).alias("vector")).mapInArrow(led, f"query_id {kind}, vector array<double>, lists array<int>")
        rows = self.table.select(_id(self.table, self.id_col), _sound(self.embedding, dim).alias("v"), "list")
        found = _scan(rows, asked, k, dim, block, room)  # queries have been led to their lists by now
        held.destroy()
        return found


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true ids that were found, of each query if there are many."""
    keys = [c for c in ("query_id", "id") if c in truth.columns]
    n = truth.count()
    return truth.join(found.select(*keys), keys, "left_semi").count() / n if n else 1.0
