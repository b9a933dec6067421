"""Ranked lexical search by Block-Max MaxScore.

Documents are indexed where they lie: each task packs what it reads into segments of about
``TERMS`` terms, and a segment is one row. Its documents are numbered by ascending id; a posting
list is cut into blocks of ``BLOCK`` postings, each with its first document, its largest frequency
and its shortest document length. Document gaps and frequencies are packed into the fewest bytes
their list allows, and a block is unpacked on its own. As the block heads hold counts and no scores,
one pass over the texts suffices, and the statistics come from the segments: documents, terms, and
the document frequencies of the words asked for.

A query goes through a segment as follows. Block heads give an upper bound of each block's scores
and so of each list's.

1. Lists are read from the greatest bound down, and the k-th best score so far is the threshold. As
   soon as all lists left cannot reach it together, they are non-essential: documents in none of the
   lists read so far are out.
2. In a non-essential list the maximum of the block that would hold a candidate, with the bounds of
   the lists after it, decides whether the candidate can still reach the threshold. Only blocks with
   such candidates are unpacked.

A task keeps one heap of the k best per query over all its segments, so thresholds rise as it goes;
the heaps are merged in two steps, by a few buckets of segments and then by query.

Queries are asked in blocks of bounded size, each against all segments.

A word's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a posting scores, in whole numbers,
weight * (10**9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N div L).

Defined results: NULL and empty texts have no words, are not counted and match nothing. Every row is
a document, so repeated rows are found as often as they occur; a NULL id comes after all others among
equal scores. Rows with one item id are one item with the least text; an item without words, or
whose words score 0, gives no rows. Without documents there are no rows. Words are compared byte by
byte once A to Z are lowered. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.session import cut

K = 10
BLOCK = 64
# Terms of a segment, about; a longer text is a segment of its own.
TERMS = 4_000_000
# Items, and bytes of their texts, that are asked at once, about.
ITEMS = 512
ITEM_BYTES = 8 << 20
BUCKETS = 64

# Letters, digits and whatever is not ASCII stay, A to Z are lowered, the rest parts the words.
_KEPT = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)
_WIDTHS = (1, 2, 4)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEPT).split()


_PARTS = {
    "docs": "<i8", "known": "?", "lengths": "<u4", "df": "<u4",
    "gap_width": "u1", "tf_width": "u1",
    "block_first": "<u4", "block_tf": "<u4", "block_n": "<u4",
    **{f"gaps{w}": f"<u{w}" for w in _WIDTHS},
    **{f"tfs{w}": f"<u{w}" for w in _WIDTHS},
}
_SEGMENT = "segment long, n_docs long, n_terms long, vocabulary binary, " + ", ".join(
    f"{name} binary" for name in _PARTS
)


def _narrowest(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.uint8)


class _Draft:
    """Documents that are gathered for the next segment."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words(text)
        if not found:
            return
        counts, known = Counter(found), self.known
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.terms.append(
            np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int64, len(counts))
        )
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.size += len(found)

    def row(self, segment: int) -> pa.RecordBatch:
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], dtype=np.int64)
        by_id = np.lexsort((ids, ~known))
        number = np.empty(len(ids), dtype=np.int64)
        number[by_id] = np.arange(len(ids))
        lengths = np.array(self.lengths, dtype=np.int64)[by_id]

        vocabulary = sorted(self.known)
        place = np.empty(len(vocabulary), dtype=np.int64)
        place[[self.known[w] for w in vocabulary]] = np.arange(len(vocabulary))
        doc = np.repeat(number, [len(t) for t in self.terms])
        term = place[np.concatenate(self.terms)]
        order = np.argsort(term * len(ids) + doc, kind="stable")
        doc, term, tf = doc[order], term[order], np.concatenate(self.tfs)[order]

        df = np.bincount(term, minlength=len(vocabulary))
        start = np.cumsum(df) - df
        heads = np.flatnonzero((np.arange(len(doc)) - start[term]) % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[heads] = 0
        gap_width = _narrowest(np.maximum.reduceat(gaps, start))
        tf_width = _narrowest(np.maximum.reduceat(tf, start))
        parts = {
            "docs": ids[by_id], "known": known[by_id], "lengths": lengths, "df": df,
            "gap_width": gap_width, "tf_width": tf_width,
            "block_first": doc[heads],
            "block_tf": np.maximum.reduceat(tf, heads),
            "block_n": np.minimum.reduceat(lengths[doc], heads),
            **{f"gaps{w}": gaps[gap_width[term] == w] for w in _WIDTHS},
            **{f"tfs{w}": tf[tf_width[term] == w] for w in _WIDTHS},
        }
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([segment], pa.int64()),
                "n_docs": pa.array([len(ids)], pa.int64()),
                "n_terms": pa.array([self.size], pa.int64()),
                "vocabulary": [b" ".join(vocabulary)],
                **{name: [parts[name].astype(kind).tobytes()] for name, kind in _PARTS.items()},
            }
        )


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: int = TERMS) -> DataFrame:
    """The documents as index segments, one row each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        segment = (context.partitionId() if context else 0) << 32
        draft = _Draft()
        for batch in batches:
            for doc_id, octets in zip(
                batch.column("id").to_pylist(), batch.column("octets").to_pylist(), strict=True
            ):
                draft.add(doc_id, octets)
                if draft.size >= terms:
                    yield draft.row(segment)
                    segment, draft = segment + 1, _Draft()
        if draft.size:
            yield draft.row(segment)

    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("octets")
    )
    return rows.mapInArrow(build, _SEGMENT)


class _Segment:
    def __init__(self, batch: pa.RecordBatch, i: int, wanted: set[bytes], n: int, total: int):
        for name, kind in _PARTS.items():
            setattr(self, name, np.frombuffer(batch.column(name)[i].as_py(), dtype=kind))
        vocabulary = batch.column("vocabulary")[i].as_py().split(b" ")
        self.place = {w: j for j, w in enumerate(vocabulary) if w in wanted}
        df = self.df.astype(np.int64)
        blocks = -(-df // BLOCK)
        self.first_block = np.cumsum(blocks) - blocks
        self.n_blocks = blocks
        self.offset = {}
        for name, width in (("gaps", self.gap_width), ("tfs", self.tf_width)):
            offset = np.zeros(len(df), dtype=np.int64)
            for w in _WIDTHS:
                own = np.where(width == w, df, 0)
                offset = np.where(width == w, np.cumsum(own) - own, offset)
            self.offset[name] = offset
        self.m = _length_part(self.lengths, n, total)
        self.bound = _impact(self.block_tf.astype(np.int64), _length_part(self.block_n, n, total))

    def heads(self, term: int) -> slice:
        at = self.first_block[term]
        return slice(at, at + self.n_blocks[term])

    def _packed(self, name: str, width: np.ndarray, term: int) -> np.ndarray:
        at = self.offset[name][term]
        return getattr(self, f"{name}{width[term]}")[at : at + self.df[term]]

    def postings(self, term: int, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and impacts of a list, or of some of its blocks."""
        gaps = self._packed("gaps", self.gap_width, term)
        tfs = self._packed("tfs", self.tf_width, term)
        first = self.block_first[self.heads(term)]
        at = np.arange(len(gaps))
        if blocks is not None:
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < len(gaps)]
        steps = gaps[at].astype(np.int64)
        run = np.cumsum(steps)
        head = np.flatnonzero(at % BLOCK == 0)  # every block chosen begins at its head
        size = np.diff(np.append(head, len(at)))
        docs = run - np.repeat(run[head], size) + np.repeat(first[at[head] // BLOCK], size)
        return docs, _impact(tfs[at].astype(np.int64), self.m[docs])


def _length_part(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m = 25 + (75 * length * N div L), exactly."""
    most = int(lengths.max(initial=0))
    wide = 75 * most * n >= 1 << 63
    m = 75 * lengths.astype(object if wide else np.int64) * n // total
    return 25 + m.astype(np.int64)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Heap:
    """The k best (score, id) so far; the threshold is the score of the last of them."""

    def __init__(self, k: int):
        self.k = k
        self.best: list[tuple[int, bool, int]] = []

    @property
    def threshold(self) -> int:
        return -self.best[-1][0] if len(self.best) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        new = [(-int(s), not k, int(i)) for s, k, i in zip(scores, known, ids, strict=True)]
        self.best = sorted(self.best + new)[: self.k]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _ask(segment: _Segment, query: dict[bytes, int], heap: _Heap) -> dict[str, int]:
    """Put a segment's best documents into the heap; ``query`` has the words' weights."""
    lists = []
    for word, weight in query.items():
        term = segment.place.get(word)
        if term is not None and weight > 0:
            lists.append((weight * int(segment.bound[segment.heads(term)].max()), term, weight))
    lists.sort()
    reach = [0]
    for bound, _, _ in lists:
        reach.append(reach[-1] + bound)

    seen = {"lists": len(lists), "essential": 0, "blocks": 0, "unpacked": 0}
    least, left = heap.threshold, len(lists)
    score = np.zeros(len(segment.docs), dtype=np.int64)
    while left and reach[left] >= least:  # an essential list
        left -= 1
        _, term, weight = lists[left]
        docs, impact = segment.postings(term)
        score[docs] += weight * impact
        least = max(least, _kth(score, heap.k))
        seen["essential"] += 1

    kept = np.flatnonzero((score > 0) & (score + reach[left] >= least))
    while left and len(kept):
        left -= 1
        _, term, weight = lists[left]
        heads = segment.heads(term)
        block = np.searchsorted(segment.block_first[heads], kept, side="right") - 1
        most = np.where(block >= 0, weight * segment.bound[heads][block], 0)
        hopeful = score[kept] + most + reach[left] >= least
        kept, block = kept[hopeful], block[hopeful]
        wanted = np.unique(block[block >= 0])
        seen["blocks"] += int(segment.n_blocks[term])
        seen["unpacked"] += len(wanted)
        if len(wanted):
            docs, impact = segment.postings(term, wanted)
            at = np.searchsorted(kept, docs)
            at[at == len(kept)] = 0
            match = kept[at] == docs if len(kept) else np.zeros(len(docs), dtype=bool)
            score[docs[match]] += weight * impact[match]
            least = max(least, _kth(score[kept], heap.k))
        kept = kept[score[kept] + reach[left] >= least]

    kept = kept[score[kept] >= max(least, 1)]
    first = np.lexsort((kept, -score[kept]))[: heap.k]  # numbers are in the order of ids
    kept = kept[first]
    heap.add(score[kept], segment.docs[kept], segment.known[kept])
    return seen


def _frequencies(segments: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each wanted word."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary = batch.column("vocabulary")[i].as_py().split(b" ")
                df = np.frombuffer(batch.column("df")[i].as_py(), dtype="<u4")
                found = [(w, int(n)) for w, n in zip(vocabulary, df, strict=True) if w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.binary()),
                     pa.array([n for _, n in found], pa.int64())],
                    names=["word", "df"],
                )

    rows = (
        segments.select("vocabulary", "df")
        .mapInArrow(counts, "word binary, df long")
        .groupBy("word")
        .agg(F.sum("df").alias("df"))
        .collect()  # no more words than the items of a block hold
    )
    return {bytes(r.word): r.df for r in rows}


def _best(
    segments: DataFrame, items: list[tuple[int, dict[bytes, int]]], n: int, total: int, k: int
) -> DataFrame:
    """(item, segment, doc_id, score): every task's k best of every item."""
    wanted = {word for _, query in items for word in query}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(k) for _ in items]
        first = None
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _Segment(batch, i, wanted, n, total)
                first = batch.column("segment")[i].as_py() if first is None else first
                for (_, query), heap in zip(items, heaps, strict=True):
                    _ask(segment, query, heap)
        rows = [
            (item, first, None if lacking else doc, -score)
            for (item, _), heap in zip(items, heaps, strict=True)
            for score, lacking, doc in heap.best
        ]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            names=["item_id", "segment", "doc_id", "score"],
        )

    return segments.drop("n_docs", "n_terms").mapInArrow(
        ask, "item_id long, segment long, doc_id long, score long"
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", "_bucket").orderBy(*best)
    all_ = Window.partitionBy("item_id").orderBy(*best)
    return (
        found.withColumn("_bucket", F.pmod(F.xxhash64("segment"), F.lit(BUCKETS)))
        .withColumn("rank", F.row_number().over(some))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(all_))
        .filter(F.col("rank") <= k)
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )


def search(
    segments: DataFrame,
    items: DataFrame,
    key: str = "item_id",
    text: str = "text",
    k: int = K,
    items_at_once: int = ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item.

    ``segments`` is a written ``index``.
    """
    asked = cut(
        items.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("octets"))
        .groupBy("id")
        .agg(F.min("octets").alias("octets")),
        "lexical-items",
    )
    n, total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).head()
    rows, octets = asked.agg(F.count("*"), F.sum(F.octet_length("octets"))).head()
    blocks = max(-(-rows // items_at_once), -(-(octets or 0) // ITEM_BYTES), 1)
    results = [
        items.sparkSession.createDataFrame(
            [], "item_id long, rank int, doc_id long, score long"
        )
    ]
    for b in range(blocks if n else 0):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        counts = [(r.id, Counter(words(r.octets))) for r in block]
        df = _frequencies(segments, {word for _, query in counts for word in query})
        weighed = [
            (
                item,
                {
                    word: times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[word] + 1)))
                    for word, times in query.items()
                    if word in df
                },
            )
            for item, query in counts
        ]
        found = cut(_best(segments, weighed, n, total, k), "lexical-heaps")
        results.append(_merged(found, k))
    return reduce(DataFrame.unionByName, results)


def ranked_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(cut(index(documents), "lexical-index"), benchmark)
