"""SimHash grouping against brute force over all pairs."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from credsift.llm import components as llm_components
from credsift.llm import simhash
from credsift.operators.components import components


def plain_fingerprint(text, n=3):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [w for w in (text or "").translate(table).translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(p.encode(), seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=3):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in values}


TEXTS = [
    None, "", " \t\n", "one", "one two", "One TWO", "one two three", "É é ÀB c d",
    "a\x0bb\x0cc\x1cd e f", "no break stays one word here", "x " * 50, "long word " * 30000,
]


def test_fingerprints_of_texts():
    for text in TEXTS:
        assert simhash.text_fingerprint(text, 3) == plain_fingerprint(text), text


def signed(values):
    return [int(v) for v in np.array(list(values), dtype="<u8").view("<i8")]


def cluster(rng, size, flips):
    centre = rng.getrandbits(64)
    return [
        centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips)))
        for _ in range(size)
    ]


@pytest.mark.parametrize("distance,crowd", [(3, 64), (3, 2), (2, 2), (1, 3), (5, 2)])
def test_groups_equal_brute_force(spark, distance, crowd, monkeypatch):
    rng = random.Random(distance * 10 + crowd)
    values = [rng.getrandbits(64) for _ in range(60)]
    for size, flips in ((40, 3), (25, 5), (12, 8)):
        values += cluster(rng, size, flips)
    values = sorted(set(signed(values)))
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.links(prints, distance, crowd)
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_groups(values, distance)
    assert {v: got.get(v, v) for v in values} == want


def test_documents(spark):
    rows = [(i, t, "src", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "one two three", "s", 1), (2, " \t\n", "src", 2), (50, "one  two\nthree", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long")
    got = simhash.near_duplicates(docs).collect()
    want = plain_groups(signed(plain_fingerprint(r[1]) for r in rows))
    ids = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            root = want[signed([plain_fingerprint(text)])[0]]
            ids[root] = min(doc_id, ids.get(root, doc_id))
    expected = sorted(
        (str(r[0]), f"{plain_fingerprint(r[1]):016x}", ids[want[signed([plain_fingerprint(r[1])])[0]]])
        for r in rows
    )
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(ids.values()))
    assert simhash.dedup(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """Spark expects one row where an explode gives many, and would send them all to the driver."""

    def written(rows, ddl, name):  # files have a size that Spark knows
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rng = random.Random(5)
    values = signed(rng.getrandbits(64) for _ in range(50))
    prints = written([(v,) for v in values], "fp long", "prints")
    assert "BroadcastHashJoin" not in plan(simhash.links(prints))
    assert "BroadcastHashJoin" not in plan(simhash._stars(prints, 3))
    edges = written([(3, 1), (3, 2), (4, 3)], "u long, v long", "edges")
    assert "BuildLeft" not in plan(llm_components._with_least(edges))
    found = llm_components.components(edges).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1), (2, 1), (3, 1), (4, 1)]
