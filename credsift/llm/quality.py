"""Quality by hierarchical empirical Bayes: text evidence with host and path posteriors.

The evidence of a text is a naive Bayes log likelihood ratio over its binned statistics, tempered
by ``TEMPER`` as they depend on each other. Its bins are counted by one grouped sum over the
labelled texts. The prior of a document is the posterior mean of its path (a part of a site), which
is shrunk towards the posterior mean of its host, which is shrunk towards the share of good
documents over all. A document counts for its site with its label, or with ``SOFT`` of its text
posterior when it has none; its own count (that of all its rows where it has a label) is taken out
before it is judged. How strongly sites
are shrunk is learnt from the spread between them (method of moments), so sparse sites follow the
whole and large ones speak for themselves.

All counts are grouped sums with map-side combining over all documents; none is sampled. Labels
of held-out rows (CRC-32 of the doc_id divisible by 5) are never used.

Defined results: NULL and empty texts are judged by their bins (no words) and their site; NULL
hosts and paths are sites of their own; repeated rows are judged alike; rows without a doc_id have
no label; conflicting labels count as bad, NULL labels not at all; without any labels all scores
are 0.5; an empty table gives no rows. Other columns pass through ``kept_documents``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.llm.common import free_name, row_key
from credsift.llm.text_stats import stats_of
from credsift.llm.toxicity import held_out
from credsift.session import cut

TEMPER = 0.7
SOFT = 0.25
THRESHOLD = 0.5
# Bounds of a site's prior strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0

# Statistic -> inner edges of its bins.
BINS = {
    "length": (1, 5, 20, 50, 100, 200, 500, 1000, 5000),
    "symbols": (0.001, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0),
    "dup_lines": (0.001, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "repeats": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9),
    "sameness": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "capitals": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "marks": (0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14),
}


def _statistics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": F.col("n_words"),
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "sameness": 1 - F.col("n_distinct") / words,
        "capitals": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks": F.col("n_marks") / words,
        "word_length": F.col("word_chars") / words,
    }


def _bin(name: str, value: Column) -> Column:
    return reduce(lambda a, b: a + b, ((value >= edge).cast("int") for edge in BINS[name]))


def _labels(labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    return (
        known.filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.min("quality") > 0).cast("double").alias("good"))
    )


def _text_model(stats: DataFrame) -> tuple[float, dict[str, list[float]]]:
    """The share of good texts, and per statistic the log ratio of each of its bins."""
    rows = (
        stats.filter("good IS NOT NULL")
        .select("good", F.explode(F.create_map(
            *(x for n in BINS for x in (F.lit(n), F.col(f"b_{n}")))
        )).alias("name", "bin"))
        .groupBy("name", "bin")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
        .collect()  # one row per bin
    )
    counts = {(r.name, r.bin): (r.good, r.bad) for r in rows}
    any_name = next(iter(BINS))
    good = sum(g for (n, _), (g, _) in counts.items() if n == any_name)
    bad = sum(b for (n, _), (_, b) in counts.items() if n == any_name)
    logs = {}
    for name, edges in BINS.items():
        size = len(edges) + 1
        cells = [counts.get((name, i), (0.0, 0.0)) for i in range(size)]
        logs[name] = [
            math.log((g + 0.5) / (good + 0.5 * size)) - math.log((b + 0.5) / (bad + 0.5 * size))
            for g, b in cells
        ]
    return (good + 1.0) / (good + bad + 2.0), logs


def _strength(sites: DataFrame, mean: str) -> float:
    """Prior strength of sites by the method of moments.

    With shares spread by v around means m, a Beta prior of strength m(1-m)/v - 1 fits; the part
    of the spread that sampling alone makes is taken off first.
    """
    share, n = F.col("g") / F.col("n"), F.col("n")
    m = F.col(mean)
    large = sites.filter(n >= 2)
    got = large.agg(
        F.sum(n * (share - m) * (share - m)).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(n * m * (1 - m)).alias("scale"),
        F.sum(n).alias("n"),
    ).head()
    if not got.n or not got.scale:
        return MOST_STRENGTH
    between = max(got.spread - got.noise, 0.0) / got.n
    if between <= 0:
        return MOST_STRENGTH
    return min(max(got.scale / got.n / between - 1, LEAST_STRENGTH), MOST_STRENGTH)


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(inside / (1 - inside))


def _mass(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("vote")).alias("g"))


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: Column) -> DataFrame:
    """(key, score): the probability that a document is good."""
    stats = docs.select(
        key.alias("key"), F.col("doc_id").alias("_doc"), host.alias("host"), path.alias("path"),
        stats_of(F.col("text")).alias("s"),
    ).select("key", "_doc", "host", "path", "s.*")
    binned = stats.select(
        "key", "_doc", "host", "path", *(_bin(n, v).alias(f"b_{n}") for n, v in _statistics().items())
    )
    known = cut(
        binned.join(_labels(labels), F.col("_doc") == F.col("_id"), "left").drop("_id"),
        "quality-stats",
    )
    share, logs = _text_model(known)
    ratio = reduce(
        lambda a, b: a + b,
        (F.get(F.array(*(F.lit(x) for x in logs[n])), F.col(f"b_{n}")) for n in BINS),
    ) * TEMPER
    weighed = known.select("key", "_doc", "host", "path", "good", ratio.alias("ratio")).select(
        "key",
        "_doc",
        "good",
        "host",
        "path",
        "ratio",
        F.when(F.col("good").isNull(), SOFT).otherwise(1.0).alias("weight"),
        F.coalesce(
            "good", 1 / (1 + F.exp(-(_logit(F.lit(share)) + F.col("ratio"))))
        ).alias("vote"),
    )

    whole = weighed.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("vote")).alias("g")).head()
    top = (whole.g + share) / (whole.n + 1) if whole.n else share
    hosts = cut(_mass(weighed, ["host"]), "quality-hosts")
    host_strength = _strength(hosts.withColumn("m", F.lit(top)), "m")
    paths = cut(
        _mass(weighed, ["host", "path"]).join(
            hosts.select(F.col("host").alias("_h"), F.col("n").alias("hn"), F.col("g").alias("hg")),
            F.col("host").eqNullSafe(F.col("_h")),
        ).drop("_h"),
        "quality-paths",
    )
    host_mean = (F.col("hg") + host_strength * top) / (F.col("hn") + host_strength)
    path_strength = _strength(paths.withColumn("m", host_mean), "m")

    sites = paths.withColumnsRenamed({"host": "_h", "path": "_p"})
    joined = weighed.join(
        sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    )
    # without the document's own count: that of the row, or of all rows with its label
    labelled = weighed.filter("good IS NOT NULL").groupBy("_doc", "host", "path").agg(
        F.sum("weight").alias("own_n"), F.sum(F.col("weight") * F.col("vote")).alias("own_g")
    )
    in_host = Window.partitionBy("_doc", "host")
    labelled = labelled.select(
        F.col("_doc").alias("_d"), F.col("host").alias("_dh"), F.col("path").alias("_dp"), "own_n",
        "own_g", F.sum("own_n").over(in_host).alias("own_hn"),
        F.sum("own_g").over(in_host).alias("own_hg"),
    )
    joined = joined.join(
        labelled,
        F.col("good").isNotNull()
        & (F.col("_doc") == F.col("_d"))
        & F.col("host").eqNullSafe(F.col("_dh"))
        & F.col("path").eqNullSafe(F.col("_dp")),
        "left",
    )
    one_n, one_g = F.col("weight"), F.col("weight") * F.col("vote")

    def less(column: str, own: str, one: Column) -> Column:
        return F.greatest(F.col(column) - F.coalesce(F.col(own), one), F.lit(0.0))

    prior = (less("hg", "own_hg", one_g) + host_strength * top) / (
        less("hn", "own_hn", one_n) + host_strength
    )
    prior = (less("g", "own_g", one_g) + path_strength * prior) / (
        less("n", "own_n", one_n) + path_strength
    )
    return joined.select(
        "key", (1 / (1 + F.exp(-(_logit(prior) + F.col("ratio"))))).alias("score")
    )


def source_of() -> tuple[Column, Column]:
    """Documents know no address: their source is the host, a language of it the path."""
    return F.col("source"), F.col("lang")


def address_of(url: Column) -> tuple[Column, Column]:
    """Host, and the first part of the path, of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)", 1)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, and whether the operator keeps it."""
    host, path = source_of()
    got = scored(docs, labels, host, path, F.struct("doc_id"))
    return got.select(
        "key.doc_id",
        held_out(F.col("key.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more."""
    host, path = source_of()
    row, bad = free_name(docs, "_row"), free_name(docs, "_bad")
    key = row_key("doc_id", F.xxhash64("text", "source", "lang"))
    low = scored(docs, labels, host, path, key).filter(F.col("score") < threshold)
    return (
        docs.withColumn(row, key)
        .join(low.select(F.col("key").alias(bad)).distinct(), F.col(row) == F.col(bad), "left_anti")
        .select(*docs.columns)
    )


def page_quality(
    pages: DataFrame, texts: Column, docs: DataFrame, labels: DataFrame
) -> DataFrame:
    """(page_id, url, host, path, score) of pages, whose addresses give host and path.

    ``texts`` is the column of their main texts. What a good text looks like is learnt from the
    labelled documents; pages have no labels, so their sites speak by the texts they hold.
    """
    source, lang = source_of()
    host, path = address_of(F.col("url"))
    none = F.lit(None)
    rows = docs.select(
        "doc_id", "text", source.alias("host"), lang.alias("path"), none.cast("long").alias("page_id"),
        none.cast("string").alias("url"), F.lit(False).alias("page"),
    ).unionByName(
        pages.select(
            none.cast(docs.schema["doc_id"].dataType).alias("doc_id"), texts.alias("text"),
            host.alias("host"), path.alias("path"), F.col("page_id").cast("long"), "url",
            F.lit(True).alias("page"),
        )
    )
    key = F.struct("page", "page_id", "url", "host", "path")
    got = scored(rows, labels, F.col("host"), F.col("path"), key).filter("key.page")
    return got.select("key.page_id", "key.url", "key.host", "key.path", "score")
