"""Reading tables, and the folder that all of a session's machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(table: DataFrame) -> DataFrame:
    """``table``, dealt to all cores if it has fewer partitions than there are. That is a
    small table in one file; larger ones have many and are left where they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session without it gets a temporary one if it is a local one, where driver and
    executors are one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="siftlight-checkpoint-"))
        where = sc.getCheckpointDir()
    return where


def settle(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table of counts that are broadcast.
_FEW = 1 << 16


def dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with ``part``: groups of over twice ``most`` rows are cut in parts by a hash of ``id``."""
    large = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * most))
    joined = rows.join(F.broadcast(large) if large.count() <= _FEW else large, keys, "left")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / most)
    return joined.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")).drop("_n")
