"""Near-duplicate documents by SimHash with a pigeonring filter.

A fingerprint has one bit per bit position that is set in more than half of the XXH64 hashes of
the text's word shingles. Two fingerprints are linked when at most ``distance`` bits differ.

Candidates: the 64 bits are split into ``distance + 1`` segments on a ring. If two fingerprints
differ in at most ``distance`` bits, there is a segment from which the differences summed over
1, 2, 3, ... consecutive segments stay within 1, 2, 3, ... times ``distance / (distance + 1)``.
So that segment is equal and it and the next one differ in at most one bit. That chain of two is
an equality join: one side lists, for each segment, itself with the next one; the other side
lists the same with none or one bit of the next one flipped. The rest of the chain is checked on
the joined pair before the full distance.

A chain key around which many fingerprints crowd is left out of that join. All fingerprints near
such keys are linked by stars instead: they meet at every point within ``(distance + 1) // 2``
bits of one and ``distance // 2`` of the other, and each point links its members to one of
them. That costs a fixed number of rows per fingerprint, whatever the crowd, and loses no link.

Defined results: NULL and blank texts have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle; equal fingerprints are in one group; rows without a
doc_id belong to the group of their fingerprint, whose id is its least doc_id, NULL if there is
none. An empty table has no groups. Other columns pass through.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from credsift.llm.common import free_name, row_hash
from credsift.llm.components import components
from credsift.session import cut

SHINGLE = 3
DISTANCE = 3
# A chain key is crowded when a neighbouring one holds more fingerprints than this.
CROWD = 64

_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_ROWS = (np.arange(8) * 256).astype(np.int64)
_CHUNK = 1 << 16
_hash = partial(xxh64_intdigest, seed=42)


def text_fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as an unsigned integer. bytes.lower and bytes.split know ASCII only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    total = len(words) - shingle + 1
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts = np.zeros((8, 256), dtype=np.int64)
    while True:  # long texts in chunks: memory stays bounded
        hashes = np.fromiter(map(_hash, _take(pieces, _CHUNK)), dtype="<u8")
        if not hashes.size:
            break
        octets = hashes.view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _ROWS).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS * 2 > total).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _take(items, n):
    for _, item in zip(range(n), items, strict=False):
        yield item


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a (signed) long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = [text_fingerprint(t, shingle) for t in texts]
        return pd.Series(np.array(values, dtype="<u8").view("<i8"))

    return prints(text)


# --- links between distinct fingerprints ---------------------------------------------------


class Ring:
    """The segments of a 64-bit fingerprint."""

    def __init__(self, distance: int):
        self.distance, self.count = distance, distance + 1
        ends = [round(64 * i / self.count) for i in range(self.count + 1)]
        self.low = ends[:-1]
        self.width = [b - a for a, b in zip(ends, ends[1:], strict=False)]

    def segment(self, fp: Column, i: int) -> Column:
        i %= self.count
        shifted = F.shiftrightunsigned(fp, self.low[i])
        return shifted.bitwiseAND(F.lit((1 << self.width[i]) - 1))

    def chain(self, fp: Column, i: int) -> Column:
        """Segment i and the next one as one number, tagged with i elsewhere."""
        after = (i + 1) % self.count
        return F.shiftleft(self.segment(fp, i), self.width[after]).bitwiseOR(
            self.segment(fp, after)
        )

    def masks(self, i: int) -> list[int]:
        """Flips of none or one bit of the second segment of a chain."""
        return [0, *(1 << b for b in range(self.width[(i + 1) % self.count]))]

    def budgets_hold(self, a: Column, b: Column) -> Column:
        """For some start, every chain of segments stays within its proportional budget."""
        differ = a.bitwiseXOR(b)
        counts = [F.bit_count(self.segment(differ, i)) for i in range(self.count)]
        starts = []
        for i in range(self.count):
            so_far, held = F.lit(0), F.lit(True)
            for length in range(1, self.count + 1):
                so_far = so_far + counts[(i + length - 1) % self.count]
                held = held & (so_far <= length * self.distance // self.count)
            starts.append(held)
        whole = starts[0]
        for held in starts[1:]:
            whole = whole | held
        return whole


def _index_rows(prints: DataFrame, ring: Ring) -> DataFrame:
    fp = F.col("fp")
    rows = F.array(
        *(F.struct(F.lit(i).alias("i"), ring.chain(fp, i).alias("key")) for i in range(ring.count))
    )
    return prints.select("fp", F.inline(rows))


def _flips(rows: DataFrame, ring: Ring) -> DataFrame:
    """The rows with their keys and every neighbouring key."""
    longest = max((ring.masks(i) for i in range(ring.count)), key=len)
    by_start = F.array(*(F.array(*(F.lit(m) for m in ring.masks(i))) for i in range(ring.count)))
    masks = by_start if len({len(ring.masks(i)) for i in range(ring.count)}) > 1 else None
    flips = F.array(*(F.lit(m) for m in longest)) if masks is None else F.get(masks, F.col("i"))
    return rows.withColumn("_flip", F.explode(flips)).withColumn(
        "key", F.col("key").bitwiseXOR(F.col("_flip").cast("long"))
    ).drop("_flip")


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``distance`` bits.

    Pairs outside crowds are all there; inside crowds the links connect the same fingerprints
    without listing every pair.
    """
    if not 1 <= distance <= 7:
        raise ValueError("distance must be from 1 to 7")
    ring = Ring(distance)
    index = _index_rows(prints, ring)
    big = cut(
        index.groupBy("i", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
        .select("i", "key"),
        "simhash-big",
    )
    crowded = not big.isEmpty()
    if crowded:
        hot = cut(_flips(big, ring).distinct(), "simhash-hot")
        dense = cut(
            _flips(index, ring).join(hot, ["i", "key"], "left_semi").select("fp").distinct(),
            "simhash-dense",
        )
        index = index.join(hot, ["i", "key"], "left_anti")
    a, b = index.withColumnRenamed("fp", "u"), _flips(_index_rows(prints, ring), ring)
    # both sides hold far more rows than Spark expects after an explode, so neither is broadcast
    pairs = (
        a.join(b.withColumnRenamed("fp", "v").hint("merge"), ["i", "key"])
        .filter(F.col("u") != F.col("v"))
        .filter(ring.budgets_hold(F.col("u"), F.col("v")))
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    return pairs.union(_stars(dense, distance)) if crowded else pairs


def _ball(prints: DataFrame, bits: Column, radius: int) -> DataFrame:
    """(z, fp): every point within ``radius`` flips of the given bits of a fingerprint."""
    out = prints.withColumn("z", F.col("fp")).withColumn("_from", F.lit(-1))
    reached = out
    for _ in range(radius):
        reached = (
            reached.withColumn("_bit", F.explode(bits))
            .filter(F.col("_bit") > F.col("_from"))
            .withColumn("z", F.expr("z ^ shiftleft(1L, _bit)"))
            .withColumn("_from", F.col("_bit"))
            .drop("_bit")
        )
        out = out.union(reached)
    return out.drop("_from")


def _stars(dense: DataFrame, distance: int) -> DataFrame:
    """Links that connect all fingerprints of ``dense`` within ``distance`` bits.

    Only bits in which some of them differ are flipped: a path between two of them needs no
    others.
    """
    either = dense.agg(F.bit_or("fp").alias("any_set"), F.bit_and("fp").alias("all_set"))
    varying = F.expr("any_set & ~all_set")
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.call_function("shiftrightunsigned", varying, b).bitwiseAND(F.lit(1)) != 0,
    )
    marked = dense.crossJoin(F.broadcast(either.select(bits.alias("bits"))))  # one row
    near = (
        _ball(marked, F.col("bits"), distance // 2)
        .groupBy("z")
        .agg(F.min("fp").alias("v"))
    )
    far = _ball(marked, F.col("bits"), distance - distance // 2).select("z", F.col("fp").alias("u"))
    # thousands of rows a fingerprint, which Spark takes for one: neither side is broadcast
    return far.join(near.hint("merge"), "z").filter("u <> v").select("u", "v").distinct()


# --- documents -----------------------------------------------------------------------------


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp) of every document; ``row`` hashes all columns."""
    return docs.select(
        "doc_id", row_hash(docs).alias("row"), fingerprint(F.col("text"), shingle).alias("fp")
    )


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root): the group of every distinct fingerprint, named by its least fingerprint."""
    distinct = cut(prints.select("fp").distinct(), "simhash-prints")
    linked = cut(components(links(distinct, distance)), "simhash-groups")
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def _grouped(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    prints = cut(fingerprinted(docs, shingle), "simhash-docs")
    return prints, cut(groups(prints, distance), "simhash-roots")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints, roots = _grouped(docs, shingle, distance)
    # ids are first brought down to one per fingerprint, so no group is gathered
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    ids = cut(first, "simhash-least")
    component = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(ids.select("fp", "root").join(component, "root"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group: the one with the least doc_id.

    Groups without any doc_id keep the row with the least hash; of rows equal in every column
    one stays.
    """
    prints, roots = _grouped(docs, shingle, distance)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = prints.groupBy("fp").agg(F.min(place).alias("first")).join(roots, "fp")
    kept = cut(first.groupBy("root").agg(F.min("first").alias("first")), "simhash-kept")
    row, key = free_name(docs, "_row"), free_name(docs, "_key")
    return _first_rows(
        docs.withColumn(row, row_hash(docs)).join(
            kept.select(F.col("first.doc_id").alias(key), F.col("first.row").alias(key + "_row")),
            F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(row) == F.col(key + "_row")),
            "left_semi",
        ),
        row,
    ).select(*docs.columns)


def _first_rows(docs: DataFrame, row: str) -> DataFrame:
    """One of the rows that are equal in every column."""
    place = free_name(docs, "_place")
    order = Window.partitionBy("doc_id", row).orderBy(F.lit(0))
    return docs.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
