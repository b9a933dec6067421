"""Token ids of a corpus as files of range-coded blocks, in ascending doc_id order.

``write`` encodes every text with the tokenizers library, appends an end id, sorts the documents
by doc_id over all files and writes shards: Parquet rows that hold a run of whole documents with
their ids coded in blocks by ``range_coder``. The folder's files are written by Spark's own commit
protocol, so lost executors leave nothing behind, and a shard is read without any other.

A shard row: file (number of the range of doc_ids), shard (its number in the file), doc_ids,
lengths (ids per document), n_ids, came and shares (the shard's distinct ids and their order-0
shares, by how often they come in it), blocks (the coded blocks). ``read`` gives the documents
back: doc_id, start (ids of all documents before), and ids as little-endian unsigned 32-bit
integers. A damaged block stops the read with ``BlockError``.

Defined results: NULL and empty texts have the end id only; documents without a doc_id come
first; documents of one doc_id follow each other in the order of a hash of their text; an empty
table gives an empty folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.llm import bpe, range_coder
from credsift.llm.common import running_totals
from credsift.session import cut, fresh_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
# Ids of a shard, unless one document has more.
SHARD_IDS = 3072 * range_coder.BLOCK
# Pre-tokens that a worker keeps.
KEPT = 1 << 20
# Bytes of ids that are handed on at once.
HANDED = 4 << 20

SHARDS = (
    "file int, shard int, n_ids long, doc_ids array<long>, lengths array<int>, "
    "came array<int>, shares array<int>, blocks array<binary>"
)


class _Shards:
    """Gathers documents and yields a shard row whenever enough ids are there."""

    def __init__(self, n_ids: int):
        self.n_ids, self.file, self.shard = n_ids, TaskContext.get().partitionId(), 0
        self._clear()

    def _clear(self) -> None:
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.size and self.size + len(ids) > SHARD_IDS:
            yield self.row()
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.ids.append(ids)
        self.size += len(ids)

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        order0 = range_coder.Order0.of(ids, self.n_ids)
        blocks = range_coder.encode(ids, self.n_ids, range_coder.BLOCK, order0)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.file], pa.int32()),
                pa.array([self.shard], pa.int32()),
                pa.array([self.size], pa.int64()),
                pa.array([self.doc_ids], pa.list_(pa.int64())),
                pa.array([self.lengths], pa.list_(pa.int32())),
                pa.array([order0.ids[:-1]], pa.list_(pa.int32())),
                pa.array([order0.shares[:-1].astype(np.int32)], pa.list_(pa.int32())),
                pa.array([blocks], pa.list_(pa.binary())),
            ],
            names=["file", "shard", "n_ids", "doc_ids", "lengths", "came", "shares", "blocks"],
        )
        self.shard += 1
        self._clear()
        return batch


def write(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> None:
    """Write the ids of ``doc_id, text`` to the folder ``path``."""
    spark = docs.sparkSession
    content = bpe.read_vocabulary(spark, vocabulary)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(content.value, KEPT)
        out = _Shards(encoder.vocabulary.size)
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            place = 0
            for ids, counts in encoder.encode(texts):
                for part in np.split(ids, np.cumsum(counts)[:-1]):
                    yield from out.add(doc_ids[place], np.concatenate([part, end]))
                    place += 1
        if out.size:
            yield out.row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text")]
    (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(shards, SHARDS)
        .write.option("compression", "none")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, ids) of all documents of a folder, ids as binary."""
    content = bpe.read_vocabulary(spark, vocabulary)
    shards = spark.read.schema(SHARDS).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_ids = bpe.worker_vocabulary(content.value).size
        for batch in batches:
            for i in range(batch.num_rows):
                file, shard, total, doc_ids, lengths, came, shares, blocks = (
                    batch.column(k)[i].as_py() for k in range(8)
                )
                order0 = range_coder.Order0(came, shares)
                ids = range_coder.decode(blocks, n_ids, order0).astype("<u4")
                if len(ids) != total or sum(lengths) != total:
                    raise range_coder.BlockError("a shard does not hold the ids it names")
                ends = np.cumsum(lengths)
                yield from _handed(file, shard, doc_ids, ends - lengths, ends, ids)

    decoded = shards.mapInArrow(
        documents, "file int, shard int, doc_id long, within long, ids binary"
    )
    # one small row per shard
    starts = cut(
        running_totals(
            shards.select("file", "shard", "n_ids"), ["file", "shard"], ["n_ids"], "token-starts"
        ).select("file", "shard", F.col("_before_n_ids").alias("first")),
        "token-starts",
    )
    return decoded.join(starts, ["file", "shard"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "ids"
    )


def _handed(file, shard, doc_ids, starts, ends, ids) -> Iterator[pa.RecordBatch]:
    """The documents of a shard in batches of bounded size."""
    octets = ids.view(np.uint8)
    a = 0
    while a < len(doc_ids):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HANDED // 4, side="right")))
        edges = np.append(starts[a:b], ends[b - 1]) - starts[a]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(b - a, file, dtype=np.int32)),
                pa.array(np.full(b - a, shard, dtype=np.int32)),
                pa.array(doc_ids[a:b], pa.int64()),
                pa.array(starts[a:b].astype(np.int64)),
                pa.Array.from_buffers(
                    pa.binary(),
                    b - a,
                    [
                        None,
                        pa.py_buffer((edges * 4).astype(np.int32)),
                        pa.py_buffer(octets[4 * starts[a] : 4 * ends[b - 1]]),
                    ],
                ),
            ],
            names=["file", "shard", "doc_id", "within", "ids"],
        )
        a = b


def files_digest(docs: DataFrame) -> DataFrame:
    """Write the documents' ids, read them back, and sum each document up."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write(docs.select("doc_id", "text"), path)
    return read(spark, path).select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
