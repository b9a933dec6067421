"""Centroid clustering over bit planes.

A vector of 64 integer components is kept as its bit planes: plane j is one unsigned 64-bit number
whose bit d is bit j of component d, in two's complement. The inner product of two vectors is then

    sum over planes i, j of  weight_i * weight_j * popcount(a_i AND b_j),

the weight of a plane being 2**j and that of the last one -2**j. Squared distances follow from three
such products and are exact. A vector has as many planes as its largest component needs, in whole
fours, so one extreme vector costs nobody else anything.

Each round is one pass over the planes. A task counts the set bits of its members by cluster, plane
and component; Spark adds the counts up, and the sums of all components, again exact whatever their
size, are put together from them. Only the centroids and these counts (clusters x planes x 64
numbers) reach the driver.

Defined results: vectors that are NULL, have not exactly 64 components, or hold NULL, NaN or
infinite ones (also once scaled) take no part and are not returned. Repeated rows are vectors of
their own. A NULL id is hashed as ``null``; rows with one hash are taken by their planes. With
fewer vectors than clusters every vector starts one; equal distances go to the smaller cluster. A
distance or inertia that no 64-bit integer holds is NULL, and the clustering is exact all the same.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.session import cut

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3

_ONE = np.uint64(1)
# Plane counts up to which all sums of a distance stay within 64 bits.
_SAFE = 28


def _bits_needed(least: int, most: int) -> int:
    """Planes that hold both numbers, in whole fours."""
    need = max((~least).bit_length() if least < 0 else 0, most.bit_length() if most > 0 else 0) + 1
    return -(-need // 4) * 4


def planes_of(ints: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 64) integers to (rows, bits) planes."""
    out = np.empty((len(ints), bits), dtype=np.uint64)
    place = _ONE << np.arange(DIM, dtype=np.uint64)
    for j in range(bits):
        if ints.dtype == object:
            bit = np.array([[(x >> j) & 1 for x in row] for row in ints], dtype=np.uint64)
        else:
            bit = (ints >> j & 1).astype(np.uint64)
        out[:, j] = (bit * place).sum(axis=1, dtype=np.uint64)
    return out


def set_bits(planes: np.ndarray) -> np.ndarray:
    """(rows, bits) planes to (rows, bits, 64) zeros and ones."""
    octets = np.ascontiguousarray(planes).astype("<u8").view(np.uint8)
    flat = np.unpackbits(octets.reshape(len(planes), -1), axis=1, bitorder="little")
    return flat.reshape(len(planes), planes.shape[1], DIM)


def weights(bits: int, wide: bool) -> np.ndarray:
    signed = [1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))]
    return np.array(signed, dtype=object if wide else np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of each row of planes ``a`` with the one vector, or the rows, ``b``."""
    wide = max(a.shape[1], b.shape[-1]) > _SAFE
    counts = np.bitwise_count(a[:, :, None] & (b[None, None, :] if b.ndim == 1 else b[:, None, :]))
    counts = counts.astype(object if wide else np.int64)
    return counts.dot(weights(b.shape[-1], wide)).dot(weights(a.shape[1], wide))


class Centroids:
    """Centroids with their planes, as the tasks use them."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.planes = []
        for vector in vectors:
            row = np.array([vector], dtype=object)
            self.planes.append(planes_of(row, _bits_needed(min(vector), max(vector)))[0])
        self.norms = [sum(x * x for x in vector) for vector in vectors]

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row."""
        wide = max(planes.shape[1], *(len(p) for p in self.planes)) > _SAFE
        own = products(planes, planes).astype(object if wide else np.int64)
        away = np.empty((len(self.planes), len(planes)), dtype=own.dtype)
        for c, centroid in enumerate(self.planes):
            away[c] = own + self.norms[c] - 2 * products(planes, centroid)
        best = away.argmin(axis=0)
        return best, away[best, np.arange(len(planes))]


def packed(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, bits, planes): the usable vectors as bit planes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                scaled = np.floor(rows.astype(np.float64) * SCALE).reshape(-1, DIM)
            keep = np.flatnonzero(np.isfinite(scaled).all(axis=1))
            scaled = scaled[keep]
            largest = np.abs(scaled).max(axis=1, initial=0)
            bits = np.empty(len(keep), dtype=np.int32)
            planes: list[bytes] = [b""] * len(keep)
            for i in range(len(keep)):
                bits[i] = _bits_needed(int(scaled[i].min()), int(scaled[i].max()))
            for width in np.unique(bits):
                at = np.flatnonzero(bits == width)
                wide = largest[at].max() >= 2.0**62
                ints = (
                    np.array([[int(x) for x in scaled[i]] for i in at], dtype=object)
                    if wide
                    else scaled[at].astype(np.int64)
                )
                for i, row in zip(at, planes_of(ints, int(width)), strict=True):
                    planes[i] = row.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), pa.array(bits),
                 pa.array(planes, pa.binary())],
                names=["id", "bits", "planes"],
            )

    whole = (F.size(vector) == DIM) & F.forall(vector, lambda x: x.isNotNull())
    rows = table.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    return rows.mapInArrow(pack, "id long, bits int, planes binary")


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch (their places and planes), vectors of one number of planes together."""
    bits = batch.column("bits").to_numpy()
    planes = batch.column("planes").to_pylist()
    for width in np.unique(bits):
        at = np.flatnonzero(bits == width)
        flat = np.frombuffer(b"".join(planes[i] for i in at), dtype="<u8")
        yield at, flat.reshape(len(at), width).astype(np.uint64, copy=False)


_COUNTS = [f"c{d}" for d in range(DIM)]


def _round(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids moved to the means of their members, rounded down."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, planes in _by_width(batch):
                width = planes.shape[1]
                cluster, _ = centroids.nearest(planes)
                for c in np.unique(cluster):
                    own = planes[cluster == c]
                    key = int(c), width
                    members[key] = members.get(key, 0) + len(own)
                    sums[key] = sums.get(key, 0) + set_bits(own).sum(axis=0, dtype=np.int64)
        rows = [(c, w, members[c, w], j) for c, w in members for j in range(w)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)),
                    *(pa.array([int(sums[c, w][j, d]) for c, w, _, j in rows]) for d in range(DIM)),
                ],
                names=["cluster", "bits", "members", "plane", *_COUNTS],
            )

    ddl = ", ".join(f"{c} long" for c in ["cluster", "bits", "members", "plane", *_COUNTS])
    totals = (
        vectors.mapInArrow(count, ddl)
        .groupBy("cluster", "bits", "plane")
        .agg(F.sum("members").alias("members"), *(F.sum(c).alias(c) for c in _COUNTS))
        .collect()
    )
    size = [0] * len(centroids.vectors)
    total = [[0] * DIM for _ in centroids.vectors]
    for row in totals:
        last = row.plane == row.bits - 1
        weight = -(1 << row.plane) if last else 1 << row.plane
        size[row.cluster] += row.members if last else 0
        for d, name in enumerate(_COUNTS):
            total[row.cluster][d] += weight * row[name]
    return Centroids(
        [
            [x // n for x in sums] if n else old
            for old, n, sums in zip(centroids.vectors, size, total, strict=True)
        ]
    )


def _assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance); NULL for a distance that 64 bits do not hold."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.empty(batch.num_rows, dtype=np.int32)
            distance = np.empty(batch.num_rows, dtype=object)
            for at, planes in _by_width(batch):
                cluster[at], distance[at] = centroids.nearest(planes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(cluster),
                    pa.array([int(x) if x < 1 << 63 else None for x in distance], pa.int64()),
                ],
                names=["id", "cluster", "distance"],
            )

    return vectors.mapInArrow(assign, "id long, cluster int, distance long")


def _start(vectors: DataFrame, clusters: int, seed: int) -> Centroids:
    """The vectors with the smallest hashes of their ids."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    first = vectors.orderBy(F.sha2(text, 256), "bits", "planes").limit(clusters).collect()
    out = []
    for row in first:
        bits = set_bits(np.frombuffer(row.planes, dtype="<u8").reshape(1, -1))[0]
        signed = weights(row.bits, True)
        out.append([int(sum(int(b) * w for b, w in zip(bits[:, d], signed, strict=True)))
                    for d in range(DIM)])
    return Centroids(out)


def cluster(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector, and the final centroids."""
    vectors = cut(packed(table, key, vector), "centroid-planes")
    centroids = _start(vectors, clusters, seed)
    for _ in range(rounds if centroids.vectors else 0):
        moved = _round(vectors, centroids)
        if moved.vectors == centroids.vectors:  # nothing moves any more
            break
        centroids = moved
    return cut(_assigned(vectors, centroids), "centroid-members"), centroids.vectors


def clusters_digest(embeddings: DataFrame) -> DataFrame:
    """Every vector with its cluster, distance, the inertias and its centroid's hash."""
    members, centroids = cluster(embeddings)
    spark = embeddings.sparkSession
    hashes = spark.createDataFrame(
        [
            (c, hashlib.sha256(",".join(map(str, vector)).encode()).hexdigest())
            for c, vector in enumerate(centroids)
        ],
        "cluster int, centroid_sha256 string",
    )

    def whole(total):
        """The sum where every distance is known and 64 bits hold it."""
        lacking = F.sum(F.col("distance").isNull().cast("int"))
        return F.when(lacking == 0, F.sum(total.cast("decimal(38,0)")).try_cast("long"))

    by_cluster = members.groupBy("cluster").agg(whole(F.col("distance")).alias("cluster_inertia"))
    inertia = members.agg(whole(F.col("distance")).alias("inertia"))
    # one row per cluster
    known = hashes.join(by_cluster, "cluster").crossJoin(inertia)
    return members.join(F.broadcast(known), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256",
    )
