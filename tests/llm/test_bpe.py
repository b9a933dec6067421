"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credsift.llm import bpe

PIECES = [
    "a", "b", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "'", "'", '"', "1",
    "23", "é", "日本", "🙂", " ", "　", "S", "The", "the", "ing", "\x1c", "\x85", "aaaa",
    "<|endoftext|>", "\x00", "é",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        return bpe.Vocabulary(file.read())


def encoded(encoder, texts):
    out = []
    for ids, counts in encoder.encode(texts):
        out += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_random_texts_equal_the_library(library, vocabulary):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 300, " " * 99 + "x", "\n" * 50, "'" * 9, "'s't're", "x'LL", "it's 'tis'"]
    want = [library.encode_ordinary(t) for t in texts]
    assert encoded(bpe.Encoder(vocabulary), texts) == want
    # a small table is renewed again and again
    assert encoded(bpe.Encoder(vocabulary, kept=1 << 8), texts) == want


def test_equal_hashes_do_no_harm(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "_hashes", lambda codes, starts: np.full(len(starts), 7, np.uint64))
    texts = ["one two three", "four five", ""]
    assert encoded(bpe.Encoder(vocabulary), texts) == [library.encode_ordinary(t) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_offsets_cover_the_text(vocabulary, text):
    ids = np.array(sum(encoded(bpe.Encoder(vocabulary, 1 << 12), [text]), []), dtype=np.int64)
    begin, end = bpe.character_offsets(vocabulary, ids, text) if len(ids) else ([], [])
    octets = vocabulary.decode(ids).tobytes()
    assert octets == text.encode()
    covered = set()
    for i, (a, b) in enumerate(zip(begin, end, strict=True)):
        covered |= set(range(a, b))
        assert vocabulary.decode(ids[i : i + 1]).tobytes() in text[a:b].encode()
    assert covered == set(range(len(text)))


def test_digests(spark, library):
    texts = [None, "", "plain words", "It's 12 o'clock\n\n  é🙂", "x" * 300_000, "plain words"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (2, "plain words", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encoding_digest(docs).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((
            str(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert bpe.encoding_digest(docs.limit(0)).count() == 0


def test_decoding_split_characters_and_nulls(spark):
    ids = spark.createDataFrame([("é🙂日",), (None,)], "text string")
    ids = ids.withColumn("ids", bpe.ids_of(spark, F.col("text")))
    cut = ids.select(F.slice("ids", 1, 2).alias("ids")).union(ids.select(F.lit(None)))
    back = [bytes(r[0]) for r in cut.select(bpe.bytes_of(spark, F.col("ids"))).collect()]
    assert "é🙂日".encode().startswith(back[0]) and back[0]
    assert back[1:] == [b"", b"", b""]
    spans = ids.select(bpe.offsets_of(spark, F.col("text"), F.col("ids")).alias("s")).collect()
    assert spans[0].s.end[-1] == 3 and spans[1].s.begin == []
