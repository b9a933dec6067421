"""Block-Max MaxScore against scores of all documents."""

import math
import random
import re

import pytest

from credsift.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t, *_ in docs]
    texts = [(i, w) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for word in set(w):
            df[word] = df.get(word, 0) + 1
    least = {}
    for i, t in items:
        if t is not None:
            least[i] = min(least.get(i, t), t, key=str.encode)
    out = []
    for item, t in least.items():
        asked = TERM.findall(t.translate(LOWER))
        scores = []
        for doc_id, w in texts:
            m = 25 + 75 * len(w) * n // total
            score = 0
            for word in asked:
                tf = w.count(word)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1)))
                    score += weight * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [
            (item, rank + 1, None if lacking else i, -s)
            for rank, (s, lacking, i) in enumerate(sorted(scores)[:k])
        ]
    return sorted(out, key=repr)


def case(kind):
    rng = random.Random(kind)
    vocabulary = [f"w{i}" for i in range(400)]
    zipf = [1 / (i + 1) for i in range(400)]

    def text(n):
        return " ".join(rng.choices(vocabulary, zipf, k=n))

    if kind == "prose":
        docs = [(i, text(rng.randint(1, 60))) for i in range(900)]
        return docs, [(i, text(12)) for i in range(15)]
    if kind == "copies":  # a third of all rows are one text; ids repeat
        docs = [(i % 70, text(6)) for i in range(200)] + [(i, "w1 w2 w2") for i in range(100)]
        return docs, [(1, "w1 w2"), (2, "w2 w2 w300"), (2, "w1"), (3, "w0"), (None, "w5 w1")]
    docs = [
        (1, None), (2, ""), (3, " \t.,!"), (None, "Alpha beta"), (None, "alpha"), (4, "ALPHA Beta"),
        (5, "Éa éa ÉA"), (6, "x" * 300 + " beta"), (7, "beta " * 30_000), (8, "a_b-c'd"),
        (9, "naïve text   x"), (10, "alpha" + " pad" * 500),
    ]
    items = [(1, "alpha beta"), (2, None), (3, ""), (4, "unknown"), (5, "éa"), (6, "ÉA a b c d"),
             (7, "x" * 300), (8, "alpha alpha beta"), (9, "naïve text"), (-1, "..."),
             (10, "pad " * 3000)]
    return docs, items


@pytest.mark.parametrize("kind", ["prose", "copies", "odd"])
@pytest.mark.parametrize("terms", [60, 5000])
def test_equals_brute_force(spark, kind, terms):
    docs, items = case(kind)
    table = spark.createDataFrame(
        [(*d, 1) for d in docs], "doc_id long, text string, score int"
    ).repartition(3)
    from credsift.session import cut

    segments = cut(lexical.index(table, terms=terms), "test-index")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(segments, asked, items_at_once=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items)


def test_blocks_are_rejected_unread():
    """Common words' blocks without a candidate stay packed."""
    rng = random.Random(1)
    draft = lexical._Draft()
    for i in range(20_000):
        rare = b" rare" if i % 4000 == 0 else b""
        draft.add(i, b" ".join([b"common"] * rng.randint(1, 3)) + b" other" * (i % 3) + rare)
    wanted = {b"common", b"rare", b"other"}
    segment = lexical._Segment(draft.row(0), 0, wanted, 20_000, draft.size)
    heap = lexical._Heap(5)
    seen = lexical._ask(segment, {b"common": 1, b"other": 300, b"rare": 9000}, heap)
    assert [doc for _, _, doc in heap.best] and all(d % 4000 == 0 for _, _, d in heap.best)
    assert seen["essential"] == 1
    assert 0 < seen["unpacked"] <= 10 < seen["blocks"]


def test_words_are_the_maximal_matches():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rng.choice([*range(128), 0xC9, 0xE9, 0x3B1, 0x1F600])) for _ in range(40))
        want = [w.encode() for w in TERM.findall(text.translate(LOWER))]
        assert lexical.words(text.encode()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_documents(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.ranked_documents(full, items.limit(0)).collect() == []
