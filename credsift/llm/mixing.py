"""Mixing sources to target weights by whole repetitions and one seeded Bernoulli copy.

Every source gets a target from its weight. A document of a source with target ``t`` and size
``s`` has the rate ``t / s``: it is emitted ``floor(rate)`` times, and once more when its own
seeded draw falls below the fraction. Sums over a source are taken with map-side combining, so
a source holding most rows costs no more than any other.

Defined results: NULL text has size 0; a NULL source is a source of its own and comes last;
empty texts take part with size 0; rows of one doc_id share one draw (so do rows without a
doc_id); a source of size 0 has target 0 and its documents are not emitted; an empty table gives
an empty mix. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.llm.common import free_name, hash_unit, running_totals, word_count
from credsift.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point take the weights in turn and share ``share`` times all sizes. No
    target exceeds ``limit`` times its source's size; what is over goes to the others by weight.
    With the sources sorted by limit per weight, the capped ones come first, so the common level
    of the rest follows from sums over the sources before each one.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(
        sums.withColumn("_last", F.col("source").isNull()), ["_last", "source"], [], "mix-sources"
    )
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = ranked.select(
        "source",
        "source_size",
        "_last",
        F.get(cycle, (F.col("_index") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(limit))).alias("most"),
    ).withColumn("ratio", F.col("most") / F.col("weight"))
    level = running_totals(weighted, ["ratio", "_last", "source"], ["most", "weight"], "mix-level")
    level = cut(level, "mix-levels")
    total, weights_sum = level.agg(F.sum("source_size") * F.lit(float(share)), F.sum("weight")).head()
    here = (F.lit(total) - F.col("_before_most")) / (
        F.lit(weights_sum) - F.col("_before_weight")
    )
    free = level.withColumn("level", here).filter(F.col("level") <= F.col("ratio"))
    common = free.agg(F.min_by("level", "_index")).head()[0]
    shared = F.lit(common).cast("double") * F.col("weight")
    return level.select(
        "source", "source_size", F.coalesce(F.least("most", shared), F.col("most")).alias("target")
    )


def copies(size: Column, source_size: Column, target: Column, key: Column, seed: str) -> Column:
    """How often a document is emitted."""
    rate = target / source_size
    whole = F.floor(rate)
    extra = (hash_unit(seed, key) < rate - whole).cast("long")
    return F.when(source_size > 0, whole + extra).otherwise(F.lit(0)).cast("long")


def with_copies(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = SEED,
) -> DataFrame:
    """Add ``mix`` = (size, source_size, target, copies) to every document.

    The targets are a written table of one row per source: Spark broadcasts it when its size
    allows, and otherwise joins with skew splitting.
    """
    here, mix = free_name(docs, "_size"), free_name(docs, "mix")
    sized = docs.withColumn(here, size)
    targets = cut(
        source_targets(
            sized.select("source", F.col(here).alias("size")), weights, share, limit
        ).withColumnsRenamed({"source": "_of", "source_size": "_total", "target": "_target"}),
        "mix-targets",
    )
    # renamed positions, so that no column of the documents can clash
    mark = {c: free_name(docs, c) for c in targets.columns}
    joined = sized.join(
        targets.withColumnsRenamed(mark), F.col("source").eqNullSafe(F.col(mark["_of"]))
    )
    total, target = F.col(mark["_total"]), F.col(mark["_target"])
    return joined.select(
        *docs.columns,
        F.struct(
            F.col(here).alias("size"),
            total.alias("source_size"),
            target.alias("target"),
            copies(F.col(here), total, target, F.col("doc_id"), seed).alias("copies"),
        ).alias(mix),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: documents repeated as often as the mix takes them."""
    marked = with_copies(docs, word_count(F.col("text")), **settings)
    column = marked.columns[-1]
    times = F.array_repeat(F.lit(0), F.col(column)["copies"].cast("int"))
    again = free_name(marked, "_copy")
    return marked.withColumn(again, F.explode(times)).select(*docs.columns)


def mixture_digest(documents: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    sized = cut(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    return with_copies(sized, F.col("size")).select(
        "doc_id",
        "size",
        F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"),
        (F.col("mix.copies") * F.col("size")).alias("taken"),
    )
