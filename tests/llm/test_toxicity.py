"""Toxicity scores: held-out accuracy, odd rows, and features against a plain statement."""

import math
import re
import zlib

import numpy as np
import pytest

from credsift.llm import toxicity
from credsift.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    wrong = [r for r in got if r.predicted != r.toxic]
    assert len(got) > 50 and len(wrong) <= 0.05 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_features_are_words_beginnings_pairs_and_skips():
    def count(text):
        words = re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower())
        words = [w.encode() for w in words if w]
        n = len(words)
        found = {("w", w) for w in words} | {("4", w[:4]) for w in words if len(w) > 4}
        found |= {("5", w[:5]) for w in words if len(w) > 5}
        found |= {("b", *words[i : i + 2]) for i in range(n - 1)}
        return len(found | {("s", words[i], words[i + 2]) for i in range(n - 2)})

    texts = ["", "one", "One two, TWO!", "a b a b a b c", "été longest words aren't", "  x "]
    number, bucket = toxicity.features([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert len(set(bucket[number == i].tolist())) == count(text), text


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "vile awful words", "fine words here"] * 40)]
    rows += [(None, "vile awful words"), (3, "fine words here"), (500, "w " * 100_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 2)) for i in range(160)] + [(None, 1), (7, None), (2, 0), (2, 1)],
        "doc_id long, toxic int",
    )
    got = toxicity.toxicity_digest(docs, labels)
    assert got.count() == len(rows)
    assert {r.predicted for r in got.filter("doc_id % 4 = 2 AND doc_id < 160").collect()} == {1}
    assert {r.predicted for r in got.filter("doc_id % 4 <> 2").collect()} == {0}
    assert got.filter("doc_id IS NULL AND NOT held_out").count() == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 41
    assert toxicity.toxicity_digest(docs.limit(0), labels).count() == 0
    bare = toxicity.toxicity_digest(docs, labels.limit(0)).collect()
    assert len(bare) == len(rows) and all(r.score <= 0.5 for r in bare)


def test_weights_are_few():
    texts = [f"common words {i} and more" for i in range(60)] + ["vile common words"] * 60
    w = toxicity.shard_weights(texts, [0] * 60 + [1] * 60)
    assert 0 < np.count_nonzero(w) < 40


def test_documents_stay_where_nothing_is_learnt(spark):
    docs = spark.createDataFrame([(i, f"words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int")
    for some in (labels.limit(0), labels, labels.filter(toxicity.held_out(labels.doc_id))):
        assert toxicity.drop_toxic(docs, some).count() == 40
        got = toxicity.toxicity_digest(docs, some).collect()
        assert len(got) == 40 and {r.predicted for r in got} == {0}
        assert all(r.score == pytest.approx(1 / (1 + math.e)) for r in got)


def test_a_doc_id_with_a_third_of_all_rows_teaches_one_text(spark):
    rows = [(i, t) for i, t in enumerate([None, "so so", "vile awful words", "fine words here"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i in range(160)], "doc_id long, toxic int")
    labels = labels.filter("NOT crc32(string(doc_id)) % 5 = 0")
    hot = labels.filter("toxic = 1").orderBy("doc_id").head().doc_id
    more = [(hot, f"vile awful words {i}") for i in range(80)]
    more = docs.union(spark.createDataFrame(more, docs.schema)).repartition(4)
    once, often = toxicity.train(docs, labels), toxicity.train(more, labels)
    assert len(once[0]) and once[0].tolist() == often[0].tolist()
    assert np.array_equal(once[1], often[1])


def plain_ftrl(rows, labels):
    """One number at a time, from the published update."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        rate = (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2
        return -(z[i] - sign * toxicity.L1) / rate

    for _ in range(toxicity.EPOCHS):
        for buckets, label in zip(rows, labels, strict=True):
            at = [*buckets, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                old = n.get(i, 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_model_and_scores_equal_a_plain_statement(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["vile", "awful", "fine", "calm", "so", "the"], 12)) for _ in range(200)]
    toxic = [int(t.count("vile") + t.count("awful") > 3) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    taught = {r.doc_id: r.label for r in toxicity.sample_labels(labels).collect()}
    order = {r.doc_id: (r.s, r.o) for r in docs.selectExpr(
        "doc_id", f"pmod(xxhash64(doc_id), {toxicity.SHARDS}) AS s",
        "xxhash64('order', doc_id) AS o").collect()}
    features = dict(enumerate(toxicity.unique_features(texts)))
    mean = {}
    for shard in range(toxicity.SHARDS):
        ids = sorted((i for i in taught if order[i][0] == shard), key=lambda i: (order[i][1], i))
        own = plain_ftrl([features[i].tolist() for i in ids], [taught[i] for i in ids])
        for bucket, w in own.items():
            mean[bucket] = mean.get(bucket, 0.0) + w * len(ids) / len(taught)
    got = toxicity.train(docs, labels)
    bias = 1 << toxicity.DIMENSION_BITS
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == pytest.approx(
        {bias if b == "bias" else b: w for b, w in mean.items()}, rel=1e-5, abs=1e-7)
    for r in toxicity.toxicity_digest(docs, labels).collect():
        total = mean.get("bias", 0.0) + sum(mean.get(int(b), 0.0) for b in features[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)
    # labels without a document do not weaken the weights
    more = labels.union(spark.range(10**6, 10**6 + 300).selectExpr("id", "int(id % 2)"))
    again = toxicity.train(docs, more)
    assert again[0].tolist() == got[0].tolist()
    assert again[1].tolist() == pytest.approx(got[1].tolist(), rel=1e-6)


def test_a_clashing_score_column(spark):
    docs = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels)
    assert got.columns == ["doc_id", "text", "score", "_score"] and got.head().score == 7
