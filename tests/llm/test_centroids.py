"""Bit-plane clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from credsift.llm import centroids


def plain(rows, k=8, rounds=10):
    kept = []
    for vec_id, vector, *_ in rows:
        if vector is None or len(vector) != 64:
            continue
        if any(x is None or not math.isfinite(x) or not math.isfinite(1024 * x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(1024 * x) for x in vector]))
    name = lambda i: "null" if i is None else str(i)

    def place(row):
        bits = centroids._bits_needed(min(row[1]), max(row[1]))
        planes = centroids.planes_of(np.array([row[1]], dtype=object), bits)
        return hashlib.sha256(f"3:{name(row[0])}".encode()).hexdigest(), bits, planes.tobytes()

    order = sorted(kept, key=place)
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((away.index(min(away)), min(away)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (at, _) in zip(kept, where, strict=True) if at == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()

    def fits(n):
        return n if n is not None and n < 2**63 else None

    def total(values):
        values = [fits(v) for v in values]
        return None if None in values else fits(sum(values))

    return sorted(
        (
            name(i), c, fits(d), total([x for a, x in where if a == c]),
            total([x for _, x in where]),
            hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest(),
        )
        for (i, _), (c, d) in zip(kept, where, strict=True)
    ) if kept else []


def vectors(kind):
    rng = random.Random(kind)
    spread = lambda s: [rng.gauss(0, s) for _ in range(64)]
    if kind == "spread":
        return [(i, spread(0.3)) for i in range(300)]
    if kind == "copies":  # a third of all rows are one vector, ids repeat, ties abound
        few = [[rng.choice([0.0, 0.5, -0.5]) for _ in range(64)] for _ in range(5)]
        return [(i % 90, rng.choice(few)) for i in range(120)] + [(i, few[0]) for i in range(60)]
    if kind == "few":
        return [(1, spread(1)), (2, spread(1)), (3, [1.0] * 63), (4, [1.0] * 65)]
    big = [(1000 + i, [x * 10.0 ** rng.randint(3, 30) for x in spread(1)]) for i in range(6)]
    odd = [(1, None), (2, []), (3, [None] + [1.0] * 63), (4, [math.nan] * 64),
           (5, [math.inf] * 64), (None, spread(0.2)), (-7, spread(0.2)), (8, [1.7e308] * 64),
           (9, [0.0] * 64), (10, [-1.0] * 64)]
    return odd + [(100 + i, spread(0.2)) for i in range(40)] + (big if kind == "big" else [])


@pytest.mark.parametrize("kind", ["spread", "copies", "few", "odd", "big"])
def test_equals_plain_arithmetic(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(
        [(*r, 0) for r in rows], "vec_id long, embedding array<double>, cluster int"
    )
    got = sorted(
        ("null" if r.vec_id is None else str(r.vec_id), r.cluster, r.distance, r.cluster_inertia,
         r.inertia, r.centroid_sha256)
        for r in centroids.clusters_digest(df).collect()
    )
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_products_of_planes():
    rng = np.random.default_rng(1)
    for top, bits in ((1 << 11, 12), (1 << 27, 28), (1 << 39, 40)):
        a, b = rng.integers(-top, top, (20, 64)), rng.integers(-top, top, 64)
        planes = centroids.planes_of(a, bits)
        assert (centroids.set_bits(planes)[:, 0] == (a & 1)).all()
        want = [sum(int(x) * int(y) for x, y in zip(row, b, strict=True)) for row in a]
        got = centroids.products(planes, centroids.planes_of(b[None, :], bits)[0])
        assert [int(x) for x in got] == want


@pytest.mark.parametrize("n, bits", [(0, 4), (7, 4), (8, 8), (-8, 4), (-9, 8), (2047, 12)])
def test_planes_needed(n, bits):
    assert centroids._bits_needed(n, n) == bits


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clusters_digest(df).collect() == []
