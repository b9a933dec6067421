"""Quality scores: held-out accuracy, shrinkage of sparse sites, odd rows."""

from pyspark.sql import functions as F

from credsift.llm import quality
from credsift.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.quality_digest(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert len(got) > 500
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_sites_speak_and_sparse_ones_follow(spark):
    text = "some plain words that are all alike in every one of these rows here"
    rows = [(i, text, f"h{i % 3}", "p") for i in range(300)]
    rows += [(1000, text, "h0", "p"), (1001, text, "h1", "p"), (1002, text, "new", "p"),
             (1003, text, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in quality.quality_digest(docs, labels).collect()}
    assert len(score) == len(rows)
    assert score[1000] < 0.2 < score[1002] < 0.95 and score[1001] > 0.8
    assert abs(score[1002] - score[1003]) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (None, "w " * 50, "a", None),
            (3, "word " * 200_000, "a", "en"), (3, "word " * 200_000, "a", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows],
                                 "doc_id long, text string, source string, lang string, score double")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.quality_digest(docs, labels)
    assert got.count() == 5 and got.filter("score BETWEEN 0 AND 1").count() == 5
    assert quality.quality_digest(docs.limit(0), labels).count() == 0
    bare = quality.quality_digest(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-6 for r in bare)
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    parts = spark.createDataFrame([("https://A.b.com:1/en/x?y",)], "u string")
    assert tuple(parts.select(*quality.address_of(F.col("u"))).head()) == ("a.b.com", "en")


def plain_scores(rows, labels):
    """Scores of (doc_id, text, host, path), one number at a time."""
    import bisect
    import math
    import zlib

    from credsift.llm import text_stats

    label = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = min(label.get(i, 1), float(q > 0))
    bins = []
    for _, text, *_ in rows:
        s = dict(zip(text_stats.FIELDS, text_stats.text_stats(text), strict=True))
        words, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
        values = {
            "length": s["n_words"], "symbols": s["n_symbols"] / words,
            "dup_lines": s["n_dup_lines"] / max(s["n_lines"], 1),
            "repeats": s["n_repeat_words"] / words, "sameness": 1 - s["n_distinct"] / words,
            "capitals": s["n_upper"] / chars, "marks": s["n_marks"] / words,
            "word_length": s["word_chars"] / words,
        }
        bins.append({n: bisect.bisect_right(quality.BINS[n], v) for n, v in values.items()})
    good = sum(label.get(r[0], 0) for r in rows if r[0] in label)
    bad = sum(1 - label[r[0]] for r in rows if r[0] in label)
    share = (good + 1) / (good + bad + 2)
    ratios = []
    for own in bins:
        total = 0.0
        for n, b in own.items():
            size = len(quality.BINS[n]) + 1
            g = sum(label[r[0]] for r, o in zip(rows, bins, strict=True) if r[0] in label and o[n] == b)
            w = sum(1 - label[r[0]] for r, o in zip(rows, bins, strict=True) if r[0] in label and o[n] == b)
            total += math.log((g + 0.5) / (good + 0.5 * size)) - math.log((w + 0.5) / (bad + 0.5 * size))
        ratios.append(total * quality.TEMPER)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    votes = [
        (1.0, label[r[0]]) if r[0] in label
        else (quality.SOFT, 1 / (1 + math.exp(-(logit(share) + x))))
        for r, x in zip(rows, ratios, strict=True)
    ]

    def mass(keep):
        some = [v for r, v in zip(rows, votes, strict=True) if keep(r)]
        return sum(w for w, _ in some), sum(w * v for w, v in some)

    def strength(sites):
        sites = [(n, g, m) for n, g, m in sites if n >= 2]
        n = sum(s[0] for s in sites)
        spread = sum(n * (g / n - m) ** 2 for n, g, m in sites)
        noise = sum(m * (1 - m) for _, _, m in sites)
        scale = sum(n * m * (1 - m) for n, _, m in sites)
        if not n or not scale or spread <= noise:
            return quality.MOST_STRENGTH
        fit = scale / n / ((spread - noise) / n) - 1
        return min(max(fit, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    n, g = mass(lambda r: True)
    top = (g + share) / (n + 1)
    hosts = {r[2]: mass(lambda x, h=r[2]: x[2] == h) for r in rows}
    hs = strength([(*m, top) for m in hosts.values()])
    mean = {h: (g + hs * top) / (n + hs) for h, (n, g) in hosts.items()}
    paths = {r[2:4]: mass(lambda x, p=r[2:4]: x[2:4] == p) for r in rows}
    ps = strength([(*m, mean[p[0]]) for p, m in paths.items()])
    out = []
    for r, x, (w, v) in zip(rows, ratios, votes, strict=True):
        if r[0] in label:  # all rows of a labelled document are its own
            own = mass(lambda y, r=r: y[0] == r[0] and y[2:4] == r[2:4])
            own_host = mass(lambda y, r=r: y[0] == r[0] and y[2] == r[2])
        else:
            own = own_host = (w, w * v)
        prior = (max(hosts[r[2]][1] - own_host[1], 0) + hs * top) / (
            max(hosts[r[2]][0] - own_host[0], 0) + hs)
        n, g = paths[r[2:4]]
        prior = (max(g - own[1], 0) + ps * prior) / (max(n - own[0], 0) + ps)
        out.append(1 / (1 + math.exp(-(logit(prior) + x))))
    return out


def test_scores_equal_a_plain_statement(spark):
    import random

    import pytest

    rng = random.Random(3)
    rows = []
    for i in range(220):
        text = " ".join(rng.choice(["Ab", "words", "x#", "end.", "long-word"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([i, i, i % 9, None]), rng.choice([text, text, None]),
                     rng.choice(["h1", "h2", "h3", None]), rng.choice(["p", "q", None])))
    labels = [(i, rng.randint(0, 1)) for i in range(0, 220, 2)] + [(3, 0), (None, 1), (5, None)]
    docs = spark.createDataFrame(
        [(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n int")
    got = quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int"),
                         F.col("source"), F.col("lang"), F.col("n")).collect()
    want = plain_scores(rows, labels)
    assert len(got) == len(rows)
    assert [r.score for r in sorted(got, key=lambda r: r.key)] == pytest.approx(want, abs=1e-9)


def test_pages_are_judged_by_address_and_text(spark):
    text = " ".join(f"plain word number {i}" for i in range(30))
    junk = "### $$$ ***\n" * 30
    docs = spark.createDataFrame(
        [(i, text if i % 2 else junk, "s", "en") for i in range(200)],
        "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    pages = [(i, f"http://{'good' if i % 3 else 'bad'}.org/a/{i}", text if i % 3 else junk) for i in range(60)]
    pages += [(100, "http://good.org/a/x", "short"), (101, "http://bad.org/a/x", "short"), (102, None, None)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in quality.page_quality(pages, F.col("html"), docs, labels).collect()}
    assert len(got) == 63 and got[0].host == "bad.org" and got[1].path == "a"
    assert all((got[i].score > 0.5) == bool(i % 3) for i in range(60))
    assert got[100].score > got[101].score
