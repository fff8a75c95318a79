"""BM25 and TF-IDF over whole tables.

Scores of one query need the frequencies of its own terms only, so texts are scored where
they are; what crosses the network are counts of documents by term, combined before the
shuffle. Nothing is capped, and documents without a query term keep their zero score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.functions.stop_words import ENGLISH
from siftlight.functions.text import tokens, word_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6


def query_terms(spark: SparkSession, query: str, of=tokens) -> list[str]:
    """A query's terms, by the very function that cuts the documents."""
    return spark.createDataFrame([(query,)], "q string").select(of(F.col("q")).alias("t")).first()["t"]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document, Okapi BM25 with a floor for terms in over half.

    One pass counts the documents and the query's terms in them, where the texts are. Only
    if a term is in over half of the documents is the mean idf of all terms needed; then
    documents are counted by term too."""
    wanted = Counter(query_terms(docs.sparkSession, query))
    cut = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    # One look at each token; what is counted are the few that the query has.
    hits = cut.select("id", F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(list(wanted))).alias("t"))
    counted = hits.select("id", "dl", *[_count("t", term).alias(f"f{j}") for j, term in enumerate(wanted)])
    seen = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{j}") > 0).alias(f"d{j}") for j in range(len(wanted))]).first()
    n = seen["n"]
    idfs = [math.log(n - d + 0.5) - math.log(d + 0.5) if d else 0.0 for d in (seen[f"d{j}"] for j in range(len(wanted)))]
    floor = EPSILON * mean_idf(cut, n) if min(idfs, default=0.0) < 0 else 0.0
    parts = []
    for j, (times, idf) in enumerate(zip(wanted.values(), idfs)):
        tf = F.col(f"f{j}")
        room = tf + K1 * (1 - B + B * F.col("dl") / F.lit(seen["avgdl"]))
        parts.append(F.when(tf > 0, times * (idf if idf >= 0 else floor) * tf * (K1 + 1) / room).otherwise(F.lit(0.0)))
    return counted.select("id", _sum(parts).alias("score"))


def mean_idf(cut: DataFrame, n: int) -> float:
    """The mean idf of all terms of ``cut`` (t), of n documents; counts are combined before
    they are shuffled."""
    by_term = cut.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return by_term.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0


def _count(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == F.lit(term)))


def term_counts(words: Column) -> Column:
    """An array of (term, tf) from an array of words: runs of equal ones, once sorted."""
    def runs(w: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
        ends = lambda f: F.array_append(F.slice(f, 2, F.size(f)), F.size(w) + 1)
        pairs = lambda f: F.zip_with(f, ends(f), lambda a, b: F.struct(F.element_at(w, a).alias("term"), (b - a).alias("tf")))
        return F.element_at(F.transform(F.array(firsts), pairs), 1)

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.element_at(F.transform(F.array(F.array_sort(words)), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none)), 1)


#: A group of documents ends before it has more tokens than this, and one document.
_MOST = 1 << 20
#: Documents of a group where groups are only to be few.
DOCS = 4096
#: White space for all bytes but those of a-z and 0-9.
_APART = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias(text)


def lengths(docs: DataFrame) -> DataFrame:
    """(id, dl) of (id, text): how many tokens each text has."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            dl = [len(t.translate(_APART).split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32())], names=["id", "dl"])

    return docs.select("id", _lowered("text")).mapInArrow(run, f"id {kind}, dl int")


def _inverted(ids: pa.Array, dls: list[int], codes: list[int], terms: list[bytes], lane: int, part: int) -> pa.RecordBatch:
    """A row for each term of some documents, whose tokens are ``codes``, one after another."""
    n = len(dls)
    pairs, tf = np.unique(np.array(codes, dtype=np.int64) * n + np.repeat(np.arange(n), dls), return_counts=True)
    term, owner = np.divmod(pairs, n)
    starts, dl = np.searchsorted(term, np.arange(len(terms) + 1)), np.array(dls, dtype=np.int32)[owner]
    lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), x) for x in (ids.take(pa.array(owner)), pa.array(tf.astype(np.int32)), pa.array(dl))]
    bounds = [pa.array(np.maximum.reduceat(tf, starts[:-1]).astype(np.int32)), pa.array(np.minimum.reduceat(dl, starts[:-1]))]
    whose = [pa.array(np.full(len(terms), lane, dtype=np.int32)), pa.array(np.full(len(terms), part, dtype=np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), *whose, *lists, *bounds], names=["term", "lane", "part", "id", "tf", "dl", "most", "shortest"])


def inverted(docs: DataFrame, group: int, lane: Column | None = None) -> DataFrame:
    """(term, lane, part, id, tf, dl, most, shortest) of (id, text): a term's postings, as three
    arrays, in a group of at most ``group`` documents of one ``lane``, with the largest count
    and the shortest document among them. Texts stay where they are.

    A group is of one task, whose number is in the upper half of ``part``. With lanes, a task
    goes through its documents in their order and that of their ids, so one that runs again
    makes the same groups."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", _lowered("text"), (F.lit(0) if lane is None else lane).cast("int").alias("lane"))

    def run(batches):
        part, at = TaskContext.get().partitionId() << 32, None
        ids, dls, codes, places = [], [], [], defaultdict(int)
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, text, where in zip(*(c.to_pylist() for c in batch.columns)):
                found = text.translate(_APART).split()
                if not found:
                    continue
                if dls and (where != at or len(dls) == group or len(codes) + len(found) > _MOST):
                    yield _inverted(pa.array(ids, id_type), dls, codes, list(places), at, part)
                    part, ids, dls, codes, places = part + 1, [], [], [], defaultdict(int)
                at, places.default_factory = where, places.__len__
                ids.append(name)
                dls.append(len(found))
                codes.extend(map(places.__getitem__, found))
        if dls:
            yield _inverted(pa.array(ids, id_type), dls, codes, list(places), at, part)

    ordered = rows if lane is None else rows.sortWithinPartitions("lane", "id")
    return ordered.mapInArrow(run, f"term string, lane int, part long, id array<{kind}>, tf array<int>, dl array<int>, most int, shortest int")


def task_of(part: str) -> Column:
    """The task that made a group. What a task says of a term must stay together: if the task
    runs again, it may make other groups."""
    return F.shiftright(F.col(part), 32)


#: idfs of so many terms (about 100 bytes each) are broadcast; more are joined by a shuffle.
_FEW_TERMS = 1_000_000


def tfidf_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document: cosine of TF-IDF vectors with smoothed idf.

    Spark's English stop list is used. Documents are counted by term, and only those with a
    term of the query have other terms counted and weighed: all others have no score. What
    is shuffled are counts by term, the terms of those few, and one score for each."""
    spark = docs.sparkSession
    wanted = Counter(t for t in query_terms(spark, query, word_tokens) if t not in set(ENGLISH))
    each_word = word_tokens(F.coalesce(F.col(text_col), F.lit("")))
    n = docs.count()
    by_term = docs.select(F.explode(F.array_distinct(each_word)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(~F.col("term").isin(list(ENGLISH)))
    idf = by_term.select("term", (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1).alias("idf")).persist()
    asked = F.when(F.lit(False), F.lit(0))
    for term, times in wanted.items():
        asked = asked.when(F.col("term") == term, F.lit(times))
    asked = F.coalesce(asked, F.lit(0))
    size = idf.agg(F.count("*").alias("terms"), F.sqrt(F.sum(F.pow(asked * F.col("idf"), 2))).alias("norm")).first()
    if not size["norm"]:
        idf.unpersist()
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    told = F.broadcast(idf) if size["terms"] <= _FEW_TERMS else idf
    # A text that lacks the letters of all terms isn't cut.
    lower = F.lower(F.col(text_col))
    held = docs.where(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(t)) for t in wanted]))
    words = F.filter(each_word, lambda w: ~w.isin(list(ENGLISH)))
    counted = held.select(F.col(id_col).alias("id"), words.alias("words")).where(F.arrays_overlap("words", F.array(*[F.lit(t) for t in wanted])))
    terms = counted.select("id", F.explode(term_counts(F.col("words"))).alias("x")).select("id", "x.term", "x.tf")
    each = terms.join(told, "term").select("id", (F.col("tf") * F.col("idf")).alias("w"), (asked * F.col("idf")).alias("q"))
    found = each.groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot > 0")
    found = found.select("id", (F.col("dot") / (F.col("norm") * F.lit(size["norm"]))).alias("score"))
    return docs.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best, rounded before they are ordered, ties by id, with their rank."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = scores.select("id", F.round("score", DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return ranked(best)


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """``rows``, of which there are few, with ``rank`` from 1."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.desc(score), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def bm25(docs: DataFrame, query: str, k: int, **columns) -> DataFrame:
    return top(bm25_scores(docs, query, **columns), k)


def tfidf(docs: DataFrame, query: str, k: int, **columns) -> DataFrame:
    return top(tfidf_scores(docs, query, **columns), k)


class LexicalIndex:
    """BM25 over tables that are written once: postings (id, term, tf, dl), terms (term, df,
    idf), sizes (mean, n, avgdl, buckets) and documents (id, dl). Postings and terms lie by
    bucket of the term, so that a query reads the buckets of its terms, and of their files
    the row groups that hold them."""

    def __init__(self, postings: DataFrame, terms: DataFrame, sizes: DataFrame, documents: DataFrame):
        self.postings, self.terms, self.sizes, self.documents = postings, terms, sizes, documents

    @classmethod
    def create(cls, docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64, spread: int = 8) -> LexicalIndex:
        """Writes the tables. Tasks invert their documents, so that a term's postings in some
        thousand of them are shuffled and sorted as one row; they go to ``spread`` tasks, so
        that a term of every document is no task's burden."""
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        blocks = inverted(rows, DOCS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        dealt = blocks.repartition("bucket", F.pmod(task_of("part"), F.lit(spread))).sortWithinPartitions("bucket", "term")
        postings = dealt.select("term", "bucket", F.explode(F.arrays_zip("id", "tf", "dl")).alias("x")).select("x.id", "term", "x.tf", "x.dl", "bucket")
        postings.write.partitionBy("bucket").parquet(f"{root}/postings")
        lengths(rows).write.parquet(f"{root}/documents")
        total = spark.read.parquet(f"{root}/documents").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        idf = F.log(total["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        terms = spark.read.schema(postings.schema).parquet(f"{root}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df")).withColumn("idf", idf)
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/terms")
        mean = spark.read.schema(terms.schema).parquet(f"{root}/terms").agg(F.avg("idf")).first()[0]
        spark.createDataFrame([(mean, total["n"], total["avgdl"], buckets)], "mean double, n long, avgdl double, buckets int").write.parquet(f"{root}/sizes")
        return cls.read(spark, root)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> LexicalIndex:
        names = {"postings": "id {}, term string, tf int, dl int, bucket int", "terms": "term string, df long, idf double, bucket int"}
        kind = spark.read.parquet(f"{root}/documents").schema["id"].dataType.simpleString()
        tables = [spark.read.schema(names[x].format(kind)).parquet(f"{root}/{x}") for x in ("postings", "terms")]
        return cls(*tables, spark.read.parquet(f"{root}/sizes"), spark.read.parquet(f"{root}/documents"))

    def search(self, query: str, k: int, drop_zero: bool = False) -> DataFrame:
        """The k best; documents without a query term fill up what is left, by id, unless
        they are to be dropped."""
        spark = self.postings.sparkSession
        wanted = Counter(query_terms(spark, query))
        if not wanted:
            return top(self.documents.select("id", F.lit(0.0).alias("score")).where(F.lit(not drop_zero)), k)
        sizes = self.sizes.first()
        asked = spark.createDataFrame(list(wanted.items()), "term string, times long")
        where = asked.select(F.pmod(F.xxhash64("term"), F.lit(sizes["buckets"])).cast("int").alias("b"))
        buckets = [r["b"] for r in where.distinct().collect()]
        names = F.col("term").isin(list(wanted)) & F.col("bucket").isin(buckets)
        idfs = {r["term"]: r["idf"] for r in self.terms.where(names).select("term", "idf").collect()}
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(wanted[t] * (idf if idf >= 0 else EPSILON * sizes["mean"]))) for t, idf in idfs.items()], F.lit(0.0))
        room = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(sizes["avgdl"]))
        scores = self.postings.where(names).groupBy("id").agg(F.sum(weight * F.col("tf") * (K1 + 1) / room).alias("score"))
        if not drop_zero:
            # As many others as could be needed, the smallest ids.
            rest = self.documents.join(scores, "id", "left_anti").orderBy("id").limit(k)
            scores = scores.unionByName(rest.select("id", F.lit(0.0).alias("score")))
        return top(scores, k)
