"""Exact top-k against brute force, with ties, copies and unusable vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from credsift.llm import topk


def plain(rows, k, asks):
    best = {}
    for vec_id, vector, *_ in rows:
        if vec_id is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(1024 * x) for x in vector]
        best[vec_id] = min(best.get(vec_id, ints), ints)
    out = []
    for q, a in best.items():
        if not asks(q):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b, strict=True)), i)
            for i, b in best.items() if i != q and len(b) == len(a)
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(kind):
    rng = random.Random(kind)
    if kind == "spread":
        rows = [(i, [rng.gauss(0, 0.2) for _ in range(7)]) for i in range(400)]
    elif kind == "copies":  # one vector has a third of all rows, few values, many ties
        rows = [(i, [rng.choice([0.0, 0.5, -0.5]) for _ in range(3)]) for i in range(200)]
        rows += [(i, [0.5, 0.5, 0.0]) for i in range(200, 320)]
    else:
        rows = [(i, [rng.uniform(-1, -0.5), 1e5 * rng.random()]) for i in range(0, 60, 5)]
        rows += [(100, None), (200, [None, 1.0]), (300, [math.nan, 1.0]), (400, [math.inf, 0.0]),
                 (None, [1.0, 1.0]), (500, []), (600, []), (10, [0.0, 0.0]), (15, [9.0, 1.0]),
                 (700, [1.0, 2.0, 3.0]), (-100, [0.25, 0.25])]
    return [(*r, "x") for r in rows]


@pytest.mark.parametrize("kind", ["spread", "copies", "odd"])
def test_equals_brute_force(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string")
    got = topk.search(df, F.col("id") % 5 == 0, k=10, rows_per_block=64).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 10, lambda i: i % 5 == 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.hundredth_queries(df).collect() == []
