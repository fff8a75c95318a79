"""Hard negatives against brute force with Python's integers."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from siftlight.llm import hard_negatives as H
from siftlight.llm import oracles
from siftlight.llm import queries as Q

SCHEMA = "vec_id long, label int, embedding array<double>, score double, id string, part int"


def brute(rows, asked, positives=5, k=5, low=80, high=100):
    sound = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fixed = [(i, l, [int(x) * 256 if abs(x) > 1e300 else math.floor(256 * x) for x in v]) for i, l, v in sound]
    most, out = 2**63 - 1, []
    for i, l, v in fixed:
        if not asked(i):
            continue
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), j, m) for j, m, w in fixed)
        own = [(j, -s) for s, j, m in scored if m == l and j != i][:positives]
        for j, p in own:
            near = [(n, -s) for s, n, m in scored if m != l and low * p <= 100 * -s <= high * p][:k]
            out += [(i, j, r, n, p, s) for r, (n, s) in enumerate(near, 1)]
    return sorted(out)


def made(spark, rows, asked, **options):
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, asked, **options).collect())


@pytest.fixture(scope="module")
def stored(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [float(x) for x in r["embedding"]]) for r in rows]


def test_query(spark, sf, stored):
    found = Q.op12_hard_negatives(spark, sf)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = sorted(tuple(r) for r in found.collect())
    assert rows and rows == brute(stored, lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = con.execute(oracles.hard_negatives())
    names = [d[0] for d in cursor.description]
    assert rows == sorted(tuple(r[names.index(c)] for c in found.columns) for r in cursor.fetchall())


def test_groups_and_parts_do_not_matter(spark, stored):
    rows = stored[:150]
    got = made(spark, rows, F.col("vec_id") % 20 == 0, positives=3, k=4, low=50, high=120, group_rows=3, part_rows=9)
    assert got and got == brute(rows, lambda i: i % 20 == 0, 3, 4, 50, 120)


def test_odd_rows(spark):
    far = 1e307
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 2, [1.0, 2.0]), (4, 2, [1.0, 2.0]), (5, 3, [0.9, 2.0, 7.0]), (6, 3, [1.0]), (7, 3, []),
        (None, 1, [1.0, 2.0]), (8, None, [1.0, 2.0]), (9, 2, None), (10, 2, [1.0, None]), (11, 2, [1.0, math.inf]), (12, 2, [math.nan, 1.0]), (13, 2, [-1.0, -2.0]),
        (3, 2, [1.0, 2.0]), (20, 4, [far, 1.0]), (21, 4, [far, 2.0]), (22, 5, [far / 2, 0.0]), (30, 4, [1e8, 1e8]), (31, 4, [-far, 0.0]), (40, 6, [1.0, 1.0]), (50, 7, [-1.0, 0.0]), (51, 7, [1.0, 0.0]),
    ]
    got = made(spark, rows, F.col("vec_id") % 10 == 0, part_rows=4, group_rows=2)
    assert got and got == brute(rows, lambda i: i % 10 == 0)


def test_hot_vector_and_label(spark):
    """A third of the rows are one vector, under two labels."""
    rows = [(i, i % 2, [1.0, 1.0]) for i in range(100)] + [(100 + i, i % 5, [i / 50, 1 - i / 300]) for i in range(200)]
    assert made(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)


def test_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert made(spark, [(1, 1, [1.0])], F.lit(None).cast("boolean")) == []
    with pytest.raises(ValueError):
        H.mine(empty, F.lit(True), k=0)
