"""Exact top-k search by a three-phase uniform threshold.

The components of the vectors are split into ``PARTS`` parts; a part's inner product is a local
score, and a score is the sum of its local scores.

1. Every block of candidates gives its best ``k`` entries of each local score list with their
   scores. The k-th best score gathered for a query is a safe cutoff: k candidates reach it.
2. The cutoff goes back to the blocks. Whoever reaches it has at least one local score of
   ``cutoff / PARTS`` or more, so each block collects the entries that have one.
3. Their scores are resolved exactly, and those at or above the cutoff are ranked.

Equal vectors are one candidate that stands for its ``k + 1`` least ids, so a vector that a third
of all rows share costs as much as any other. Queries and candidates are packed into blocks of
bounded size that meet pair by pair; nothing is broadcast and no block is gathered elsewhere.

Defined results: vectors that are NULL or hold NULL, NaN or infinite components take no part,
neither do rows without an id; of several rows of one id the least vector counts; vectors of
different lengths do not meet; empty vectors score 0 with each other; ties go to the smaller id;
queries with fewer than k candidates return them all. Scores are 64-bit integers. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.session import cut

K = 10
PARTS = 2
SCALE = 1024
# Vectors of a block, about.
ROWS = 8192


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, ints) with ints = floor(scale * x), one row per id."""
    whole = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    usable = F.col(key).isNotNull() & F.coalesce(whole, F.lit(False))
    rows = table.filter(usable).select(F.col(key).cast("long").alias("id"), ints.alias("ints"))
    return rows.groupBy("id").agg(F.min("ints").alias("ints"))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(g, ints, ids): equal vectors once, with their k + 1 least ids; g is the least of them."""
    first = Window.partitionBy("ints").orderBy("id")
    return (
        rows.withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") <= k + 1)
        .groupBy("ints")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("g"), "ints", "ids")
    )


_PACKED = "dim int, block int, gs binary, sizes binary, matrix binary"


def _packed(vectors: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block: the numbers, multiplicities (or cutoffs) and components of its vectors."""

    def pack(table: pa.Table) -> pa.Table:
        flat = table.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "gs": [table.column("g").to_numpy().astype("<i8").tobytes()],
                "sizes": [table.column("size").to_numpy().astype("<i8").tobytes()],
                "matrix": [flat.astype("<i8").tobytes()],
            }
        )

    return cut(
        vectors.withColumn("dim", F.size("ints"))
        .withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block")
        .applyInArrow(pack, _PACKED),
        name,
    )


def _pairs(queries: DataFrame, candidates: DataFrame, q_blocks: int, c_blocks: int) -> DataFrame:
    """Every block of queries beside every block of candidates of the same length. The join key
    is the pair of blocks, so no key has more than one row on either side."""

    def renamed(df: DataFrame, letter: str, own: str) -> DataFrame:
        return df.withColumnsRenamed(
            {"block": own, "gs": letter + "gs", "sizes": letter + "sizes", "matrix": letter + "matrix"}
        )

    def spread(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    left = spread(renamed(queries, "q", "qb"), "cb", c_blocks)
    right = spread(renamed(candidates, "c", "cb"), "qb", q_blocks)
    return left.join(right, ["dim", "qb", "cb"]).select(
        "dim", "qgs", "qsizes", "qmatrix", "cgs", "csizes", "cmatrix"
    )


def _unpacked(batch: pa.RecordBatch, i: int):
    dim, *octets = (batch.column(c)[i].as_py() for c in range(7))
    qg, qs, qm, cg, cs, cm = (np.frombuffer(o, dtype="<i8") for o in octets)
    return qg, qs, qm.reshape(len(qg), dim), cg, cs, cm.reshape(len(cg), dim)


def _local_scores(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The parts' inner products, exactly."""
    edges = [round(q.shape[1] * j / PARTS) for j in range(PARTS + 1)]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**52:  # sums that doubles hold exactly
        q, c = q.astype(np.float64), c.astype(np.float64)
    return [
        (q[:, a:b] @ c[:, a:b].T).astype(np.int64) for a, b in zip(edges, edges[1:], strict=False)
    ]


# Score cells that are held at once.
_CELLS = 1 << 22


def _slices(qn: int, cn: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(cn, 1))
    for a in range(0, qn, step):
        yield slice(a, a + step)


def _local_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: (q, c, size, score) of the best entries of every local list."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qg, _, qm, cg, cs, cm = _unpacked(batch, i)
                for part in _slices(len(qg), len(cg)):
                    local = _local_scores(qm[part], cm)
                    score = sum(local)
                    n = min(k + 1, len(cg))
                    at = [np.argpartition(-s, n - 1, axis=1)[:, :n] for s in local]
                    at = np.concatenate(at, axis=1)
                    rows = np.repeat(np.arange(len(at)), at.shape[1])
                    at = at.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (qg[part][rows], cg[at], cs[at], score[rows, at])],
                        names=["q", "c", "size", "score"],
                    )

    return pairs.mapInArrow(best, "q long, c long, size long, score long")


def _cutoffs(lists: DataFrame, k: int) -> DataFrame:
    """(q, cutoff): the best score that at least k gathered candidates reach, if there is one.

    The query's own row is no candidate, hence one less of its own vector.
    """
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return (
        lists.distinct()
        .withColumn("size", F.col("size") - (F.col("q") == F.col("c")).cast("long"))
        .withColumn("_place", F.row_number().over(best))
        .filter(F.col("_place") <= k + 1)
        .withColumn("_reach", F.sum("size").over(best))
        .filter(F.col("_reach") >= k)
        .groupBy("q")
        .agg(F.max("score").alias("cutoff"))
    )


def _collected(pairs: DataFrame, k: int) -> DataFrame:
    """Phases 2 and 3: (q, c, score) of what can be among the k best of a query."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qg, cutoff, qm, cg, _, cm = _unpacked(batch, i)
                for part in _slices(len(qg), len(cg)):
                    local = _local_scores(qm[part], cm)
                    least = cutoff[part][:, None]
                    open_ = least == _NO_CUTOFF
                    share = -(-np.where(open_, 0, least) // PARTS)  # rounded up
                    enough = local[0] >= share
                    for s in local[1:]:
                        enough |= s >= share
                    row, col = np.nonzero(enough | open_)
                    score = sum(s[row, col] for s in local)
                    good = score >= cutoff[part][row]
                    row, col, score = row[good], col[good], score[good]
                    order = np.lexsort((cg[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    begin = np.searchsorted(row, row, side="left")
                    few = np.arange(len(row)) - begin < k + 2
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(x)
                            for x in (qg[part][row[few]], cg[col[few]], score[few])
                        ],
                        names=["q", "c", "score"],
                    )

    return pairs.mapInArrow(collect, "q long, c long, score long")


_NO_CUTOFF = -(1 << 63)


def search(
    table: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rows_per_block: int = ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the k best of every row but the query's own.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = cut(integer_vectors(table, key, vector), "topk-rows")
    vectors = cut(_distinct(rows, k), "topk-vectors")
    asked = cut(
        rows.filter(is_query).join(vectors.select("g", "ints"), "ints").select("id", "g"),
        "topk-queries",
    )
    wanted = vectors.join(asked.select("g").distinct(), "g", "left_semi").select("g", "ints")
    c_blocks = max(1, -(-vectors.count() // rows_per_block))
    q_blocks = max(1, -(-asked.select("g").distinct().count() // rows_per_block))

    candidates = _packed(
        vectors.select("g", "ints", F.size("ids").cast("long").alias("size")),
        c_blocks,
        "topk-candidates",
    )
    queries = _packed(wanted.withColumn("size", F.lit(0).cast("long")), q_blocks, "topk-asked")
    lists = _local_lists(_pairs(queries, candidates, q_blocks, c_blocks), k)
    cutoffs = cut(_cutoffs(lists, k), "topk-cutoffs")

    told = wanted.join(cutoffs, wanted["g"] == cutoffs["q"], "left").select(
        "g", "ints", F.coalesce("cutoff", F.lit(_NO_CUTOFF)).cast("long").alias("size")
    )
    queries = _packed(told, q_blocks, "topk-told")
    found = cut(_collected(_pairs(queries, candidates, q_blocks, c_blocks), k), "topk-found")

    place = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    ranked = (
        found.join(vectors.select(F.col("g").alias("c"), "ids"), "c")
        .select(F.col("q").alias("g"), "score", F.explode("ids").alias("id"))
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= k + 1)
    )
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        asked.withColumnRenamed("id", "query_id")
        .join(ranked.drop("_place"), "g")
        .filter(F.col("query_id") != F.col("id"))
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    )


def hundredth_queries(embeddings: DataFrame) -> DataFrame:
    """The 10 best of every row whose vec_id is divisible by 100."""
    return search(embeddings, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
