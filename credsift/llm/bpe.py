"""Byte-level BPE over Arrow batches with the tokenizers library.

Texts are cut into pre-tokens by array operations over all characters of a batch. Every pre-token
that a worker has not met yet goes through the library once; its ids are kept in a bounded table
keyed by a 64-bit hash, so the cost of a text is that of cutting and looking up. The ids of each
text are turned back to bytes and compared with the text; a text that differs (two pre-tokens with
one hash) is encoded again piece by piece, so results never rest on the hash.

A byte-level vocabulary spells bytes as printable characters. Printable Latin-1 characters stand
for themselves, the other bytes for the characters from 256 on. ``decode`` reverses that table;
characters split over several tokens come back as their bytes are joined. Offsets count
characters: a token's span runs from the character of its first byte to that of its last one, so
tokens that share a split character share it in their spans, too.

Defined results: a NULL text is an empty one, which has no ids; repeated rows are encoded alike;
special-token strings in a text are ordinary text; NULL ids decode to no bytes. Other columns
pass through.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers


RANKS = "byte_bpe_multi_50k.tiktoken"
# Characters that are cut at once, and pre-tokens kept per worker before the table is renewed. A
# stage that has one Python worker per task may keep more than one that has two.
CHUNK = 1 << 18
KEPT = 1 << 18

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_QUOTE, _BLANK = ord("'"), ord(" ")
# Words that the library gets at once: it is faster with short lines. The byte between them is in no
# UTF-8 text.
LINE = 200
_BETWEEN = b"\xff"


# --- vocabularies ----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that spells each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [spelled[b] for b in range(256)]


def _from_ranks(content: bytes) -> tuple[Tokenizer, list[bytes]]:
    """The library's model for a file of ranks: every way to join two entries into a third one,
    in the order of the third one's rank."""
    ranks = {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in content.splitlines() if line)
    }
    spell = byte_characters()
    names = {token: "".join(spell[b] for b in token) for token in ranks}
    merges = [
        (names[token[:i]], names[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(
        vocab={names[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True
    )
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    return tokenizer, spelled


def _from_json(content: bytes) -> tuple[Tokenizer, list[bytes]]:
    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    spelled = [b""] * (max(vocab.values()) + 1)
    for name, number in vocab.items():
        spelled[number] = bytes(back[c] for c in name)
    for token in json.loads(content)["added_tokens"]:
        if token["id"] >= len(spelled):
            spelled += [b""] * (token["id"] + 1 - len(spelled))
        spelled[token["id"]] = token["content"].encode()
    return tokenizer, spelled


class Vocabulary:
    """A tokenizer with the bytes of its ids in one array."""

    def __init__(self, content: bytes):
        is_json = content.lstrip()[:1] == b"{"
        self.tokenizer, spelled = (_from_json if is_json else _from_ranks)(content)
        self.size = len(spelled)
        self.lengths = np.array([len(s) for s in spelled], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.octets = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        # the same model for words that are spelled by byte characters, of which none is a blank
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.spelled = np.array([ord(c) for c in byte_characters()], dtype="<u4")
        self.spelled[ord(_BETWEEN)] = _BLANK

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        ids, counts = [], []
        for i in range(0, len(words), LINE):
            some = words[i : i + LINE]
            octets = _BETWEEN.join([w.encode() for w in some])
            line = self.spelled[np.frombuffer(octets, dtype=np.uint8)].tobytes().decode("utf-32-le")
            done = self.speller.encode(line, add_special_tokens=False)
            ids.append(np.array(done.ids, dtype=np.int32))
            of = np.array(done.word_ids, dtype=np.int64)
            counts.append(np.bincount(of, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, joined."""
        return self.octets[ranges(self.starts[ids], self.lengths[ids])]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + length - 1 of each pair, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total)
    return out


# --- cutting into pre-tokens -----------------------------------------------------------------


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    classes = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda p: p if p < 0xD800 else p + 0x800  # noqa: E731  no surrogates in texts
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            for a, b in ((run.start(), min(run.end(), 0xD800)), (max(run.start(), 0xD800), run.end())):
                if a < b:
                    classes[shift(a) : shift(b - 1) + 1] = kind
    return classes


def cut_points(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN begin; ``begins`` are the texts' starts.

    Runs of one class are matches, with these exceptions: a blank before a run of letters,
    numbers or others belongs to it; of white space before a run the last character stands
    alone, or is that blank; and a lone quote takes the letters of a contraction.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = character_classes()[codes]
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    first = np.zeros(n, dtype=bool)
    first[begins[begins < n]] = True
    change |= first
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    what, opens = kind[start], first[start]
    closes = np.append(opens[1:], True)

    mark = change
    gap = np.flatnonzero((what == _SPACE) & ~closes)
    last = end[gap] - 1
    mark[last] = True  # the last character of white space before a run
    joined = codes[last] == _BLANK
    mark[end[gap[joined]]] = False  # a blank that the run takes

    quote = np.flatnonzero(
        (what == _OTHER) & (codes[start] == _QUOTE) & (end - start == 1) & ~closes & mark[start]
    )
    quote = quote[what[np.minimum(quote + 1, len(what) - 1)] == _LETTER]
    if len(quote):
        a, stop = end[quote], end[quote + 1]
        one = codes[a]
        two = np.where(stop - a > 1, codes[np.minimum(a + 1, n - 1)], 0)
        takes = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            takes[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        a, stop, takes = a[takes > 0], stop[takes > 0], takes[takes > 0]
        mark[a] = False
        rest = a + takes < stop
        mark[(a + takes)[rest]] = True
    return np.flatnonzero(mark)


def _hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash per pre-token: the sum of mixed (character, place) pairs."""
    place = np.arange(len(codes), dtype=np.uint64)
    place -= np.repeat(starts.view(np.uint64), np.diff(np.append(starts, len(codes))))
    x = codes.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    place *= np.uint64(0xC2B2AE3D27D4EB4F)
    x += place
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.add.reduceat(x, starts)


# --- the worker's encoder --------------------------------------------------------------------


class Encoder:
    """Encodes lists of texts; keeps the ids of known pre-tokens in an open table."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        self.vocabulary, self.kept = vocabulary, kept
        self._renew()

    def _renew(self) -> None:
        size = 2 * self.kept
        self.keys = np.zeros(size, dtype=np.uint64)  # 0: free
        self.entry = np.zeros(size, dtype=np.int32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int32)
        self.pool = np.zeros(1 << 14, dtype=np.int32)
        self.count = self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where unknown."""
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        here = self.keys[at]
        hit = here == hashes
        found = self.entry[at].astype(np.int64)
        found[~hit] = -1
        open_ = np.flatnonzero(~hit & (here != 0))
        step = 1
        while len(open_):
            at = (hashes[open_] + np.uint64(step)) & mask
            here = self.keys[at]
            hit = here == hashes[open_]
            found[open_[hit]] = self.entry[at[hit]]
            open_ = open_[~hit & (here != 0)]
            step += 1
        return found

    def _place(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        step = 0
        while len(hashes):
            at = (hashes + np.uint64(step)) & mask
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = hashes[free]  # of several in one place the last one stays
            self.entry[at[free]] = entries[free]
            left = self.keys[at] != hashes
            hashes, entries, step = hashes[left], entries[left], step + 1

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, lengths = self.vocabulary.encode_words(words)
        top, fill = self.count + len(words), self.used + len(ids)
        for name, need in (("starts", top), ("lengths", top), ("pool", fill)):
            held = getattr(self, name)
            if need > len(held):
                grown = np.zeros(max(need, 2 * len(held)), dtype=held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)
        self.lengths[self.count : top] = lengths
        self.starts[self.count : top] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : fill] = ids
        self._place(hashes, np.arange(self.count, top))
        self.count, self.used = top, fill

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) for t in texts])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        starts = cut_points(codes, begins)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        hashes = _hashes(codes, starts)
        hashes[hashes == 0] = 1
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            unseen, where = np.unique(hashes[new], return_index=True)
            if len(unseen) > self.kept:  # one very long text
                return self._all_plain(texts)
            if self.count + len(unseen) > self.kept:
                self._renew()
                return self._chunk(texts)
            a = starts[new[where]]
            b = np.append(starts, len(codes))[new[where] + 1]
            self._learn(unseen, [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            found[new] = self._find(hashes[new])
        lengths = self.lengths[found].astype(np.int64)
        ids = self.pool[ranges(self.starts[found], lengths)]
        # ids per text: pre-tokens never reach over the end of a text
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = sums[np.searchsorted(starts, np.append(begins, len(codes)))]
        counts = np.diff(edges)
        octets = self.vocabulary.decode(ids)
        if octets.tobytes() != joined.encode("utf-8", "surrogatepass"):
            return self._all_plain(texts)
        return ids, counts

    def _all_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = [self._plain(t) for t in texts]
        return np.concatenate(done), np.array([len(d) for d in done], dtype=np.int64)

    def _plain(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = cut_points(codes, np.zeros(1, dtype=np.int64)).tolist()
        if not starts:
            return np.zeros(0, dtype=np.int32)
        words = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        return self.vocabulary.encode_words(words)[0]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (ids, number of ids per text) for consecutive runs of texts."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= CHUNK):
                chars += len(texts[j])
                j += 1
            yield self._chunk(texts[i:j])
            i = j


_workers: dict = {}


def worker_encoder(content: bytes, kept: int = KEPT) -> Encoder:
    """One encoder per Python worker, vocabulary and size, reused over tasks."""
    key = ("encoder", hash(content), kept)
    if key not in _workers:
        _workers[key] = Encoder(worker_vocabulary(content), kept)
    return _workers[key]


def worker_vocabulary(content: bytes) -> Vocabulary:
    key = ("vocabulary", hash(content))
    if key not in _workers:
        _workers[key] = Vocabulary(content)
    return _workers[key]


def read_vocabulary(spark: SparkSession, name: str) -> object:
    """The vocabulary file, fixed in size, sent to the executors once."""
    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


# --- columns ---------------------------------------------------------------------------------


def ids_of(spark: SparkSession, text: Column, vocabulary: str = RANKS) -> Column:
    """The ids of a text column as array<int>."""
    content = read_vocabulary(spark, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(content.value)
        for batch in texts:
            ids, counts = [], []
            for some, n in encoder.encode([t or "" for t in batch.to_pylist()]):
                ids.append(some)
                counts.append(n)
            yield list_array(ids, counts)

    return encode(text)


def list_array(values: list[np.ndarray], counts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, dtype=np.int32)]).astype(np.int32, copy=False)
    each = np.concatenate([np.zeros(1, dtype=np.int64), *counts])
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(each).astype(np.int32)), pa.array(flat, pa.int32())
    )


def bytes_of(spark: SparkSession, ids: Column, vocabulary: str = RANKS) -> Column:
    """The bytes that an array of ids spells."""
    content = read_vocabulary(spark, vocabulary)

    @F.arrow_udf("binary")
    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = worker_vocabulary(content.value)
        for batch in lists:
            filled = batch.fill_null([]) if batch.null_count else batch
            flat = filled.flatten().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(known.lengths[flat])])
            sizes = np.concatenate([[0], np.cumsum(filled.value_lengths().to_numpy())])
            octets = known.decode(flat).tobytes()
            yield pa.Array.from_buffers(
                pa.binary(),
                len(batch),
                [None, pa.py_buffer(edges[sizes].astype(np.int32)), pa.py_buffer(octets)],
            )

    return decode(ids)


def character_offsets(known: Vocabulary, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters at which each token begins and ends (exclusive)."""
    octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    character = np.cumsum((octets & 0xC0) != 0x80) - 1  # of each byte
    end = np.cumsum(known.lengths[ids])
    return character[end - known.lengths[ids]], character[end - 1] + 1


def offsets_of(spark: SparkSession, text: Column, ids: Column, vocabulary: str = RANKS) -> Column:
    """The character spans of the tokens, as struct<begin: array<int>, end: array<int>>."""
    content = read_vocabulary(spark, vocabulary)

    @F.pandas_udf("begin array<int>, end array<int>")
    def spans(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        known = worker_vocabulary(content.value)
        both = [
            character_offsets(known, np.asarray(i, dtype=np.int64), t or "") if len(i) else ([], [])
            for t, i in zip(texts, lists, strict=True)
        ]
        return pd.DataFrame({"begin": [b for b, _ in both], "end": [e for _, e in both]})

    return spans(text, ids)


def encode(docs: DataFrame, vocabulary: str = RANKS, name: str = "ids") -> DataFrame:
    """Add the ids of ``text``."""
    return docs.withColumn(name, ids_of(docs.sparkSession, F.col("text"), vocabulary))


def encoding_digest(docs: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """Per document: number of ids, their digest, and the digest of the decoded bytes."""
    spark = docs.sparkSession
    ids = encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bytes_of(spark, F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )
