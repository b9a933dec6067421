"""Language identification: held-out accuracy, fusion of evidence, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from credsift.llm import language
from credsift.llm.common import hash_unit, table


def test_accuracy_on_unseen_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    seen = hash_unit("test", F.col("doc_id")) < 0.6
    model = language.train(language.known_texts(docs.filter(seen)))
    records = language.document_records(docs.filter(~seen), F.struct("doc_id"))
    got = language.identify(records, model).select("key.doc_id", "language")
    pairs = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(pairs) > 300
    assert np.mean([r.language == r.lang for r in pairs]) > 0.97


def test_trigrams_by_hand():
    def plain(text):
        octets = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32
                       for b in text.lower().encode())
        octets = b" " + octets + b"  "
        return sum(sum(c != 32 for c in octets[i : i + 3]) > 1 for i in range(len(octets) - 2))

    texts = ["", "a", "ab", "abc d", "x, y. z!", "été 42 ok", "  lead"]
    number, _ = language.trigrams([t.encode() for t in texts])
    assert [int((number == i).sum()) for i in range(len(texts))] == [plain(t) for t in texts]


def test_pages_weigh_markup_address_and_host(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html")
    empty = '<html lang="{}"><body></body></html>'
    extra = [
        (-1, "http://nowhere.example.org/fr/1", empty.format("fr")),
        (-2, "no address", "<p></p>"),
        (-3, None, None),
        (-4, "http://nowhere.example.org/de/1", empty.format("de-AT")),
    ]
    rows = pages.union(spark.createDataFrame(extra, pages.schema)).withColumn("key", F.lit("x"))
    got = {r.page_id: r for r in language.page_languages(rows, docs).collect()}
    assert got[-1].language == "fr" and got[-1].kept
    assert got[-4].language == "de" and got[-4].kept
    assert len(got) == rows.count() and got[-3].confidence < 0.9
    told = pages.withColumn("told", language.declared_language(F.col("html"))).collect()
    assert np.mean([got[r.page_id].language == r.told for r in told]) > 0.97


def test_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(
        "doc_id", "text", "lang", "source", F.lit("x").alias("key"), F.lit(1.0).alias("host")
    )
    extra = [
        (-1, None, None, None), (-2, "", "en", "src0"), (-3, "### 12 ### !!! " * 50, None, "src1"),
        (-4, "qxzk wvqj zxkq jqvx " * 400, None, "src1"), (None, "of the and that is with " * 9, None, None),
        (-5, "of the and that is with " * 60_000, None, "src0"),
    ]
    extra = spark.createDataFrame([(*r, "x", 1.0) for r in extra], docs.schema)
    both = docs.union(extra).union(extra.filter("doc_id = -5"))
    model = language.train(language.known_texts(docs))
    kept = language.kept_documents(both, model)
    assert kept.columns == both.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert -4 not in ids and ids.count(-5) == 2 and None in ids
    assert len(ids) >= 0.99 * docs.count()
    assert language.document_languages(both.limit(0)).count() == 0
    found = language.document_languages(both)
    assert found.count() == both.count()
    only = language.kept_documents(both, model, ["de"]).select("lang").distinct().collect()
    assert "es" not in [r.lang for r in only]


def test_addresses(spark):
    urls = [
        ("https://u@Blog.Site.example.com:80/en/7#x", "blog.site.example.com", "example.com", "com/en"),
        ("http://a.fr", "a.fr", "a.fr", "fr/"),
        ("http://h.de/fragen/x", "h.de", "h.de", "de/"),
        ("nonsense", None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(u[0],) for u in urls], "url string")
    host = language.host_of(F.col("url"))
    got = df.select(
        "url", host, language.domain_of(host), language.suffix_of(F.col("url"))
    ).collect()
    assert [tuple(r) for r in got] == urls


def invented(name, words):
    """A text of made-up words that share few trigrams with those of other names."""
    seed = np.random.default_rng(sum(ord(c) * 31**i for i, c in enumerate(name)))
    letters = seed.choice(list("abcdefghijklmnopqrstuvwxyz"), size=(12, 5))
    known = ["".join(w) for w in letters]
    return " ".join(known[i % 12] for i in range(words))


def test_a_language_of_one_in_100_000_rows_is_learnt(spark):
    common = F.when(F.col("doc_id") % 2 == 0, invented("aa", 40)).otherwise(invented("bb", 40))
    docs = spark.range(199_998).select(
        F.col("id").alias("doc_id")
    ).select(
        "doc_id",
        F.concat(common, F.lit(" "), (F.col("doc_id") % 97).cast("string")).alias("text"),
        F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb").alias("lang"),
        F.lit("s").alias("source"),
    )
    rare = [(i, invented("zz", 60 + i), "zz", "s") for i in (300_001, 300_002)]
    docs = docs.union(spark.createDataFrame(rare, docs.schema))
    model = language.train(language.known_texts(docs))
    assert model.languages == ["aa", "bb", "zz"]
    found = language.identify(
        language.document_records(docs.filter("doc_id % 1000 = 0 OR lang = 'zz'"), F.struct("doc_id")),
        model,
    ).join(docs.select("doc_id", "lang"), F.col("key.doc_id") == F.col("doc_id"))
    assert [r for r in found.collect() if r.language != r.lang] == []
    few = docs.filter("doc_id < 500 OR lang = 'zz'")
    kept = [r.doc_id for r in language.kept_documents(few, model).collect()]
    assert {300_001, 300_002} <= set(kept) and len(kept) == 502


def test_every_language_is_learnt_however_many(spark):
    names = [f"l{i:02d}" for i in range(70)]
    rows = [
        (100 * i + j, f"{invented(name, 50)} {j}", name, "s")
        for i, name in enumerate(names)
        for j in range(1 + i % 3)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language.train(language.known_texts(docs)).languages == names
    got = language.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(rows) and all(r.language == r.lang and r.kept for r in got)


def test_sample_of_rows_without_an_id_and_without_letters(spark):
    rows = [(None, f"{invented('aa', 20)} {i}", "aa") for i in range(400)]
    rows += [(None, f"{invented('bb', 20)} {i}", "bb") for i in range(3)] + [(7, "12 34", "cc")] * 9
    texts = spark.createDataFrame(rows, "id long, text string, language string")
    assert language.train(texts, size=1).languages == ["aa", "bb"]
    assert language.train(texts.limit(0)).classes == [language.UNDETERMINED]
