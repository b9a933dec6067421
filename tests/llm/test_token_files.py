"""Range-coded token files: exact round trips, checksums, and the library's own ids."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credsift.llm import bpe, range_coder, token_files
from credsift.session import fresh_path


@given(st.lists(st.integers(0, 700), max_size=400), st.integers(1, 90), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_any_ids_come_back(ids, block, repeat):
    ids = np.array(ids * repeat, dtype=np.int64)
    blocks = range_coder.encode(ids, 701, block)
    assert len(blocks) == -(-len(ids) // block)
    assert (range_coder.decode(blocks, 701) == ids).all()
    for i, data in enumerate(blocks):  # every block by itself
        assert (range_coder.decode([data], 701) == ids[i * block : (i + 1) * block]).all()


@pytest.mark.parametrize("n_ids,count", [(2, 9000), (50257, 20000), (65536, 5000)])
def test_long_runs(n_ids, count):
    rng = np.random.default_rng(n_ids)
    ids = np.where(rng.random(count) < 0.5, rng.integers(0, n_ids, count), n_ids - 1)
    assert (range_coder.decode(range_coder.encode(ids, n_ids), n_ids) == ids).all()
    constant = np.full(count, n_ids - 1)
    coded = range_coder.encode(constant, n_ids)
    assert sum(map(len, coded)) < count / 4
    assert (range_coder.decode(coded, n_ids) == constant).all()


def test_damage_is_found():
    ids = np.arange(3000) % 500
    (block,) = range_coder.encode(ids, 500)
    for at in (1, 5, 13, 40, len(block) // 2):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(range_coder.BlockError):
            range_coder.decode([bytes(broken)], 500)
    with pytest.raises(range_coder.BlockError):
        range_coder.decode([block[:-2]], 500)


def _uneven(count, seed=5):
    """Ids that differ in frequency as those of texts do, spread over a vocabulary."""
    rng = np.random.default_rng(seed)
    return (rng.zipf(1.3, count) % 4000) * 11 + 3


def test_counted_ids_take_less_room_than_zlib():
    ids = _uneven(40_000)
    order0 = range_coder.Order0.of(ids, 50257)
    blocks = range_coder.encode(ids, 50257, range_coder.BLOCK, order0)
    cuts = range(0, len(ids), range_coder.BLOCK)
    plain = sum(len(zlib.compress(ids[i : i + range_coder.BLOCK].astype("<u2"), 9)) for i in cuts)
    assert sum(map(len, blocks)) < 0.9 * plain
    assert (range_coder.decode(blocks, 50257, order0) == ids).all()
    for i, data in zip(cuts, blocks, strict=True):  # every block by itself
        own = range_coder.decode([data], 50257, order0)
        assert (own == ids[i : i + range_coder.BLOCK]).all()


@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=300), st.integers(1, 90))
@settings(max_examples=60, deadline=None)
def test_any_counted_ids_come_back(ids, block):
    ids = np.array(ids)
    order0 = range_coder.Order0.of(ids, 70_001)
    assert order0.shares[:-1].sum() == 1 << order0.bits
    kept = range_coder.Order0(order0.ids[:-1].tolist(), order0.shares[:-1].tolist())
    blocks = range_coder.encode(ids, 70_001, block, order0)
    assert (range_coder.decode(blocks, 70_001, kept) == ids).all()


def test_uncounted_ids_and_damaged_shares_are_found():
    order0 = range_coder.Order0.of(np.array([1, 1, 4]), 9)
    with pytest.raises(ValueError):
        range_coder.encode(np.array([1, 2]), 9, order0=order0)
    for shares in ([1, 2], [1 << 16], [0, 1 << 16], [-1, (1 << 16) + 1]):
        with pytest.raises(range_coder.BlockError):
            range_coder.Order0([1, 4], shares)


def test_the_coder_costs_little_beside_zlib():
    ids = _uneven(1_500_000)
    order0 = range_coder.Order0.of(ids, 50257)

    def seconds(work):
        times = []
        for _ in range(3):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    def coder():
        blocks = range_coder.encode(ids, 50257, range_coder.BLOCK, order0)
        assert (range_coder.decode(blocks, 50257, order0) == ids).all()

    octets = ids.astype("<u2").tobytes()
    assert seconds(coder) < 2.5 * seconds(lambda: zlib.decompress(zlib.compress(octets, 6)))


def test_words_are_encoded_as_within_their_text():
    path = public_tokenizers.path(token_files.VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, "rb") as file:
        encoder = bpe.Encoder(bpe.Vocabulary(file.read()))
    rng = random.Random(7)
    pieces = ["a", "ing", " the", " ", "  ", "\n", "\t", "'", "'re", "1", "é", "日本", "🙂"]
    pieces += ["\xa0", "\x85", "Ġ", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(2000)]
    got = [part for ids, n in encoder.encode(texts) for part in np.split(ids, np.cumsum(n)[:-1])]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [part.tolist() for part in got] == want


TEXTS = [None, "", "It's a test, a test!", "é🙂 <|endoftext|> x", "word " * 30_000, "a\n\n b"]


def test_documents_come_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 1000)
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    library.encode_special_tokens = True
    rows = [(100 - i, t, "c") for i, t in enumerate(TEXTS * 4)] + [(None, "none", "c"), (100, "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = token_files.files_digest(docs).collect()

    def ids(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")

    want = sorted((str(r[0]), len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *np.cumsum([r.n_tokens for r in by_start])[:-1].tolist()]
    keys = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert keys == sorted(keys)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = fresh_path(spark, "empty")
    token_files.write(docs, path)
    assert token_files.read(spark, path).count() == 0
    assert token_files.files_digest(docs).agg(F.sum("start")).head()[0] is None
