"""Aggregates of timings and storage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def percentiles(rows: DataFrame, value: str, percents: tuple[float, ...], small: int = 1_000_000, cuts: int = 1000) -> DataFrame:
    """One row with p50 and the like: exact nearest-rank percentiles of a table of any size.

    Up to ``small`` rows are sorted in one task. In a larger table approximate quantiles
    part the values into ranges, whose counts tell the range that has the rank, until that
    is small; nothing is shuffled but counts."""
    rows = rows.select(F.col(value).alias("v")).where("v IS NOT NULL")
    total = rows.count()
    ranks = [max(1, math.ceil(total * p / 100)) for p in percents]
    if not total:
        found = [None] * len(ranks)
    elif total <= small:
        by_rank = _small(rows, set(ranks))
        found = [by_rank[r] for r in ranks]
    else:
        found = [_at_rank(rows, r, total, small, cuts) for r in ranks]
    kind = rows.schema["v"].dataType
    schema = T.StructType([T.StructField(f"p{p:g}", kind) for p in percents])
    return rows.sparkSession.createDataFrame([tuple(found)], schema)


def _small(rows: DataFrame, ranks: set[int]) -> dict:
    """The values of some ranks, from 1."""
    order = F.row_number().over(Window.orderBy("v"))
    return {r["rank"]: r["v"] for r in rows.withColumn("rank", order).where(F.col("rank").isin(sorted(ranks))).collect()}


def _at_rank(rows: DataFrame, rank: int, total: int, small: int, cuts: int):
    """The value of that rank."""
    kind = rows.schema["v"].dataType.simpleString()
    while total > small:
        shares = [i / cuts for i in range(1, cuts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("v", shares, 10 * cuts).alias("q")).first()["q"]))
        # One literal; it is folded before anything runs.
        held = F.split(F.lit(",".join(map(str, bounds))), ",").cast(f"array<{kind}>")
        # Binary search: how many bounds are below the value.
        place = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(bounds).bit_length())),
            F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
            lambda s, _: _halved(s, held),
            lambda s: s["lo"],
        )
        counts = sorted((r["place"], r["count"]) for r in rows.groupBy(place.alias("place")).count().collect())
        for at, n in counts:
            if rank <= n:
                break
            rank -= n
        if n == total:  # every value is at or below this bound, most of them at it
            n = rows.where(F.col("v") < bounds[at]).count()
            if rank > n:
                return bounds[at]
            rows = rows.where(F.col("v") < bounds[at])
        else:
            if at > 0:
                rows = rows.where(F.col("v") > bounds[at - 1])
            if at < len(bounds):
                rows = rows.where(F.col("v") <= bounds[at])
        total = n
    return _small(rows, {rank})[rank]


def _halved(s: Column, held: Column) -> Column:
    middle = F.shiftright(s["lo"] + s["hi"], 1)
    above = F.col("v") > F.get(held, middle)
    live = s["lo"] < s["hi"]
    return F.struct(
        F.when(live & above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(live & ~above, middle).otherwise(s["hi"]).alias("hi")
    )


def latency_stats(runs: DataFrame, run: str = "run", value: str = "ms") -> DataFrame:
    """One row: best, best of the first ten, mean, p50, p95, p99, max of the timings."""
    ranked = percentiles(runs, value, (50, 95, 99)).first()
    return runs.agg(
        F.min(value).alias("best"), F.min(F.when(F.col(run) < 10, F.col(value))).alias("best_of_10"), F.avg(value).alias("mean"),
        *(F.lit(ranked[p]).cast(runs.schema[value].dataType).alias(p) for p in ("p50", "p95", "p99")), F.max(value).alias("max"),
    )


def human_bytes(size: Column) -> Column:
    """Bytes with thousands separators, and in KiB, MiB or GiB."""
    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%,d B (%.2f {unit})", size.cast("long"), (size / float(1024**power)).cast("double"))

    return F.when(size < 1024**2, scaled(1, "KiB")).when(size < 1024**3, scaled(2, "MiB")).otherwise(scaled(3, "GiB"))


def storage_projection(spark, dim: int, counts=(1_000, 1_000_000), bytes_per_number: int = 4) -> DataFrame:
    """What so many vectors take: vectors, bytes, shown."""
    rows = spark.createDataFrame([(n,) for n in counts], "vectors long")
    rows = rows.withColumn("bytes", F.col("vectors") * dim * bytes_per_number)
    return rows.withColumn("shown", human_bytes(F.col("bytes")))
