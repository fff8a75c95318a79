"""Timings of actions, and the report on them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlight.functions.stats import latency_stats, storage_projection

RUNS, WARM_UPS, SIZES = 30, 3, (1, 10, 50, 100)
SCALING_RUNS, INSERT_RUNS = 20, 8


def timed(action: Callable[[], object]) -> float:
    """Milliseconds of one call."""
    began = time.perf_counter()
    action()
    return (time.perf_counter() - began) * 1000


def run(df: DataFrame) -> None:
    """Computes all of ``df`` and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def bench(spark: SparkSession, action: Callable[[], object], runs: int = RUNS, warm_ups: int = WARM_UPS) -> DataFrame:
    """One row of latency statistics over ``runs`` calls after some that don't count."""
    for _ in range(warm_ups):
        action()
    return latency_stats(spark.createDataFrame([(i, timed(action)) for i in range(runs)], "run int, ms double"))


def cycled(docs: list[str], n: int) -> list[str]:
    """n documents, taken in turns."""
    return [docs[i % len(docs)] for i in range(n)] if docs else []


def scaling(action: Callable[[int], Callable[[], object]], sizes: tuple[int, ...] = SIZES, runs: int = SCALING_RUNS) -> list[tuple[int, float, float]]:
    """(batch size, least milliseconds, items a second by the mean) of ``runs`` calls of
    ``action(size)``, made before the clock starts."""
    out = []
    for size in sizes:
        times = [timed(action(size)) for _ in range(runs)]
        out.append((size, min(times), size * len(times) * 1000 / max(1e-9, sum(times))))
    return out


def embed_scaling(embedder, docs: list[str], **options) -> list[tuple[int, float, float]]:
    """Batches of texts through an embedder."""
    return scaling(lambda n: lambda texts=cycled(docs, n): embedder.encode(texts), **options)


def insert_scaling(spark: SparkSession, embedder, docs: list[str], root: str, runs: int = INSERT_RUNS, **options) -> list[tuple[int, float, float]]:
    """Batches of rows, embedded before, into a fresh table each."""
    from siftlight.sources.store import Properties, Store, build_rows

    made = iter(range(1 << 30))

    def insert(n: int):
        texts = [f"{i} {t}" for i, t in enumerate(cycled(docs, n))]
        rows, store = build_rows(spark, texts, embedder.encode(texts), embedder.model_id), Store(spark, f"{root}/run-{next(made)}")
        return lambda: store.write(rows, Properties(embedder.model_id, embedder.dim))

    return scaling(insert, runs=runs, **options)


_SHOWN = ("best", "best_of_10", "mean", "p50", "p95", "p99", "max")


def line(name: str, row) -> str:
    """A row of a markdown table."""
    return "| " + " | ".join([name, *(f"{row[c]:.3f}" for c in _SHOWN)]) + " |"


def report(spark: SparkSession, measured: dict[str, DataFrame], dim: int, scaled: dict[str, list[tuple[int, float, float]]] | None = None) -> str:
    """Markdown: latencies in milliseconds, what batches of each size took, and what vectors take."""
    head = ["| metric | best | best of 10 | mean | p50 | p95 | p99 | max |", "|---|---|---|---|---|---|---|---|"]
    rows = [line(name, df.first()) for name, df in measured.items()]
    batches = []
    for name, found in (scaled or {}).items():
        batches += [f"## {name} by batch size", "", "| batch | best (ms) | per second |", "|---|---|---|", *(f"| {n} | {ms:.3f} | {rate:.1f} |" for n, ms, rate in found), ""]
    room = [f"- {r['vectors']:,} vectors: {r['shown']}" for r in storage_projection(spark, dim).collect()]
    return "\n".join(["## Latency (ms)", "", *head, *rows, "", *batches, "## Storage", "", *room, ""])
