"""Connected components of linked fingerprints, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.session import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours; hubs are summed up map-side."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # every u is there; a left join can broadcast the least ends only, never the pairs
    return pairs.join(least, "u", "left").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _with_least(both)
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold the greater end first."""
    marked = _with_least(edges)
    return (
        marked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(marked.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root the least node reachable.

    ``links`` holds (u, v). Each step is written to the shared folder, so lineage stays short
    and lost executors cost a re-read. The steps end when the links no longer change, after a
    number of rounds that grows with the logarithm of the longest path.
    """
    edges = cut(
        links.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_small_star(_large_star(edges)), "stars")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """One row that changes with the set of links."""
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).head()
    )
