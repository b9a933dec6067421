"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text, each counted once, in ``1 << DIMENSION_BITS`` buckets: words, word beginnings
of four and five bytes, pairs of neighbouring words (n-grams), and pairs with one word between
them (skip-grams). Words are lower-cased runs between ASCII blanks and punctuation.

Training takes at most about ``SAMPLE`` labelled rows, at most half of them toxic and at most two
clean ones for a toxic one, chosen by a hash of the doc_id. A doc_id teaches one text, the least
of its texts, however many rows it has. The features of these texts are dealt to ``SHARDS`` tasks,
each of which runs FTRL-proximal (per-coordinate rates, L1 sparsity) for ``EPOCHS`` passes over its
texts, in the order of a hash and up to ``SHARD_FEATURES`` features in all; the mean of the shards'
weights, by the texts that taught them, is the model. L1 leaves few weights, and there are never more than buckets, so the
model's broadcast size is bounded by design (8 bytes a bucket).

Defined results: NULL and empty texts score the bias alone; rows without a doc_id are scored, are
not held out and teach nothing; a doc_id labelled twice counts as toxic if one label says so; NULL
labels teach nothing, nor do labels without a document; where nothing has been learnt (no labels, none
left after the hold-out, or no weight that outlasts L1) every score is that of ``UNTAUGHT_BIAS``,
below 0.5, so that no document counts as toxic and ``drop_toxic`` keeps them all; an empty table
gives no rows. Other columns pass through ``scored``; its score gets a free name if they have one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.llm.common import free_name, hash_unit
from credsift.session import cut

DIMENSION_BITS = 20
SAMPLE = 16_000
SHARDS = 2
SHARD_FEATURES = 1 << 25
EPOCHS = 4
UNTAUGHT_BIAS = -1.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 5.0, 1.0
CHUNK = 1 << 18
_TAUGHT = -1  # in place of a bucket: the number of texts that taught

_BLANKS = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b
                for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    salted = hashes + np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & (1 << 64) - 1)
    return (_mix(salted) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature, repeats included."""
    joined = b" ".join([*texts, b""]).lower().translate(_BLANKS)
    octets = np.frombuffer(joined, dtype=np.uint8)
    inside = octets != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, start, side="right")

    bounds = np.concatenate([[0], start, [len(octets)]])
    place = np.arange(len(octets)) - np.repeat(bounds[:-1], np.diff(bounds))
    codes = octets * np.uint64(0x9E3779B97F4A7C15)
    codes += place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    codes = np.where(inside, _mix(codes), np.uint64(0))
    word = np.add.reduceat(codes, start)
    found = [(text, _buckets(word, 0))]
    for kind, length in ((1, 4), (2, 5)):
        longer = end - start > length
        beginning = np.add.reduceat(np.where(place < length, codes, np.uint64(0)), start)
        found.append((text[longer], _buckets(beginning[longer], kind)))
    for kind, gap in ((3, 1), (4, 2)):
        same = text[:-gap] == text[gap:]
        pair = word[:-gap] * np.uint64(0xD6E8FEB86659FD93) + word[gap:]
        found.append((text[:-gap][same], _buckets(pair[same], kind)))
    return np.concatenate([t for t, _ in found]), np.concatenate([b for _, b in found])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, with the number of the first one."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


# --- learning --------------------------------------------------------------------------------


class Ftrl:
    """Follow-the-regularised-leader for features of value 1; bucket 0 of ``dim`` is the bias."""

    def __init__(self, dim: int):
        self.z = np.zeros(dim + 1)
        self.n = np.zeros(dim + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * L1 - z
        w = shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, len(self.z) - 1)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def unique_features(texts: list[str | None]) -> list[np.ndarray]:
    """The buckets of each text, each once; never more than ``1 << DIMENSION_BITS``."""
    rows = []
    for _, some in chunks(texts):
        number, bucket = features(some)
        keys = np.unique(number << DIMENSION_BITS | bucket)
        parts = np.searchsorted(keys, np.arange(1, len(some)) << DIMENSION_BITS)
        rows += np.split((keys & (1 << DIMENSION_BITS) - 1).astype(np.int32), parts)
    return rows


def learnt_weights(rows: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """The weights that one shard learns from the features of its texts, the bias last."""
    dim = 1 << DIMENSION_BITS
    model = Ftrl(dim)
    for _ in range(EPOCHS):
        for buckets, label in zip(rows, labels, strict=True):
            model.learn(buckets, label)
    return model.weights(np.arange(dim + 1))


def shard_weights(texts: list[str], labels: list[int]) -> np.ndarray:
    """The weights that one shard learns, the bias last."""
    return learnt_weights(unique_features(texts), labels)


def hashed(text: Column) -> Column:
    """The features of a text column, as an array of buckets."""

    @F.arrow_udf("array<int>")
    def buckets(texts: pa.Array) -> pa.Array:
        rows = unique_features(texts.to_pylist())
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        joined = np.concatenate([np.zeros(0, dtype=np.int32), *rows])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(joined))

    return buckets(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of about ``size`` labelled rows at most, none of them held out."""
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
    )
    toxic, clean = known.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    ).head()
    wanted = {1: min(toxic, size / 2), 0: min(clean, size / 2, 2 * toxic)}
    share = [wanted[label] / max(n, 1) for label, n in ((0, clean), (1, toxic))]
    return known.filter(
        hash_unit("toxic-sample", F.col("doc_id"))
        < F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    )


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of all weights that are not zero; the bias has bucket 2^DIMENSION_BITS.

    Where nothing has been learnt, the bias alone calls every text clean.
    """
    sample = cut(sample_labels(labels, size), "toxic-sample")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))
    # the sample is bounded by its parameter, so it may be sent to all tasks; a minimum combines
    # map-side, so a doc_id with most rows gives one text per task
    taught = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "label", hashed(F.col("text")).alias("buckets"))
        .withColumn("shard", shard)
        .withColumn("order", F.xxhash64(F.lit("order"), "doc_id"))
    )
    # a shard learns from whole texts, as many as its bound on features holds
    so_far = Window.partitionBy("shard").orderBy("order", "doc_id")
    taught = taught.withColumn("_sum", F.sum(F.size("buckets")).over(so_far)).filter(
        F.col("_sum") <= SHARD_FEATURES
    )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id"], kind="stable")
        w = learnt_weights(rows["buckets"].tolist(), rows["label"].tolist())
        at = np.flatnonzero(w)
        return pd.DataFrame(
            {"bucket": np.append(at, _TAUGHT), "weight": np.append(w[at], 1.0) * len(rows)}
        )

    fitted = cut(
        taught.drop("_sum").groupBy("shard").applyInPandas(learn, "bucket int, weight double"),
        "toxic-weights",
    )
    # at most one row per bucket
    mean = fitted.groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas()
    mean = mean.sort_values("bucket")
    known = mean["bucket"].to_numpy(np.int64) != _TAUGHT
    if not known.any():
        return np.array([1 << DIMENSION_BITS]), np.array([UNTAUGHT_BIAS], dtype=np.float32)
    weights = mean["weight"].to_numpy()
    return (
        mean["bucket"].to_numpy(np.int64)[known],
        (weights[known] / weights[~known].sum()).astype(np.float32),
    )


def dense(model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weights = np.zeros((1 << DIMENSION_BITS) + 1, dtype=np.float32)
    weights[model[0]] = model[1]
    return weights


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    scores = np.full(len(texts), float(weights[-1]))
    for first, some in chunks(texts):
        number, bucket = features(some)
        hit = np.flatnonzero(weights[bucket])
        keys = np.unique(number[hit] << DIMENSION_BITS | bucket[hit])
        w = weights[keys & (1 << DIMENSION_BITS) - 1].astype(np.float64)
        scores[first : first + len(some)] += np.bincount(
            keys >> DIMENSION_BITS, weights=w, minlength=len(some)
        )
    return _sigmoid(scores)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: Column) -> Column:
    """The probability of toxicity of a text column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = dense(sent.value)
        for batch in batches:
            yield pa.array(score_texts(batch.to_pylist(), weights))

    return scores(text)


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """The documents with a toxicity score, learnt from the labels that are not held out."""
    model = train(docs, labels)
    return docs.withColumn(free_name(docs, name), score(docs, model, F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``; all of them where nothing has been learnt."""
    model = train(docs, labels)
    name = free_name(docs, "_score")
    marked = docs.withColumn(name, score(docs, model, F.col("text")))
    return marked.filter(F.col(name) < limit).select(*docs.columns)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    toxic = F.col("score") >= 0.5
    return docs.select("doc_id", score(docs, model, F.col("text")).alias("score")).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        toxic.cast("int").alias("predicted"),
    )
