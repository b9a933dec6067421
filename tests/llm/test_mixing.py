"""Mixing: odd rows, targets near, limits kept."""

from pyspark.sql import functions as F

from credsift.llm import mixing


def test_odd_rows_and_limits(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}", 1.0) for i in range(800)]
    rows += [(900, None, "s0", 1.0), (901, "", None, 1.0), (902, "one two", None, 1.0),
             (None, "three words here", "only", 1.0), (None, "three words here", "only", 1.0),
             (903, None, "empty", 1.0), (5, "again " * 5, "s1", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mixture_digest(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    sums = {}
    for r in got:
        entry = sums.setdefault((r.source_size, r.target), [0, 0])
        entry[0] += r.size
        entry[1] += r.taken
    assert all(target <= 2 * size for size, target in sums)
    for (size, target), (_, taken) in sums.items():
        if size > 500:
            assert abs(taken - target) < 0.15 * target
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    sizes = mixed.select(F.sum(mixing.word_count(F.col("text")))).head()[0]
    assert sizes == sum(r.taken for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mixture_digest(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
