"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.sources import tables
from siftlight.sources.tables import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[list]]:
    """The columns of ``batches`` as Python lists, ``step`` rows at a time, so that
    a batch of long texts is never held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [column.to_pylist() for column in part.columns]


def tidy(run: Callable) -> Callable:
    """``run`` (for mapInArrow), after which the worker gives the memory it has freed back to
    the system. Workers outlive their tasks; what they keep counts beside the next stage's."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return tidied


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partition_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return 0 if context is None else context.partitionId()
