"""Joining ranked lists, and choosing diverse results from one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.operators.lexical import DIGITS, top

RRF_K, ALPHA, DIVERSITY = 60, 0.5, 0.5


def reciprocal_rank(lists: list[DataFrame], k: int | None = None, damping: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (damping + rank) over the lists (id, rank)."""
    each = reduce(DataFrame.unionByName, [x.select("id", (1.0 / (damping + F.col("rank"))).alias("part")) for x in lists])
    fused = each.groupBy("id").agg(F.round(F.sum("part"), 12).alias("score"))
    return fused if k is None else _first(fused, k)


def _first(scores: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def minmax(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores from 0 to 1; all 0 where they are equal."""
    bounds = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, F.lit(0.0)).otherwise((F.col(score) - F.col("_lo")) / span)
    return rows.crossJoin(F.broadcast(bounds)).withColumn(score, scaled).drop("_lo", "_hi")


def weighted(dense: DataFrame, lexical: DataFrame, k: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """alpha times the dense and 1 - alpha times the lexical score, both scaled to 0 to 1;
    a document that is in one list only has 0 in the other."""
    a = minmax(dense.select("id", "score")).select("id", F.col("score").alias("a"))
    b = minmax(lexical.select("id", "score")).select("id", F.col("score").alias("b"))
    mixed = alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))
    fused = a.join(b, "id", "full_outer").select("id", mixed.alias("score"))
    return fused if k is None else top(fused, k)


def mmr(pool: DataFrame, k: int, trade: float = DIVERSITY) -> DataFrame:
    """(id, score, rank): maximal marginal relevance over a pool of candidates
    (id, score, vector of unit length), in the order of picking; the score is relevance.

    The pool, which retrieval has limited, is one row of arrays, and the picks are a fold
    over it: ``state`` holds picked places and each candidate's largest likeness to one."""
    if k < 1:
        raise ValueError("k must be at least 1")
    row = pool.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("key"), "id", "score", F.col("vector").cast("array<double>").alias("vector")))).alias("pool"))
    start = F.struct(
        F.array().cast("array<int>").alias("picked"),
        F.transform("pool", lambda _: F.lit(None).cast("double")).alias("near"),
    )

    def likeness(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def pick(state, _):
        # Marginal scores by place; the smallest place wins ties.
        scored = F.transform(
            F.sequence(F.lit(0), F.size("pool") - 1),
            lambda i: F.struct(
                F.round(trade * F.get("pool", i)["score"] - (1 - trade) * F.coalesce(F.get(state["near"], i), F.lit(0.0)), 12).alias("gain"),
                (-i).alias("place"),
            ),
        )
        free = F.filter(scored, lambda x: ~F.array_contains(state["picked"], -x["place"]))
        best = -F.array_max(free)["place"]
        return F.when(F.size(free) == 0, state).otherwise(
            F.struct(
                F.array_append(state["picked"], best).alias("picked"),
                F.zip_with(
                    state["near"], F.transform("pool", lambda c: likeness(c["vector"], F.get("pool", best)["vector"])),
                    lambda old, new: F.greatest(old, new),
                ).alias("near"),
            )
        )

    picks = F.when(F.size("pool") == 0, F.array().cast("array<int>")).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, pick, lambda s: s["picked"])
    )
    chosen = row.select("pool", F.posexplode(picks).alias("at", "place"))
    return chosen.select(
        F.get("pool", F.col("place"))["id"].alias("id"), F.round(F.get("pool", F.col("place"))["score"], DIGITS).alias("score"),
        (F.col("at") + 1).cast("long").alias("rank"),
    )
