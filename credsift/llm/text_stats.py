"""Counts over whole texts that quality rules and the quality classifier share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_upper", "n_marks",
)
WINDOW = 3

_NO_SYMBOLS = SYMBOLS.encode()
_UPPER = bytes(range(65, 91))
_MARKS = b"!?.,;:-_=~^+\"'()[]{}/\\"
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANKS = b" \t\n\r\x0b\x0c"
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def _count(octets: bytes, some: bytes) -> int:
    return len(octets) - len(octets.translate(None, some))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    key = ids[:n]
    for i in range(1, window):
        if i > 1:  # pairs, triples, ... numbered anew, so that the next product fits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[i : n + i]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(window):
        covered[i : n + i] |= again
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of ``FIELDS``. bytes.split knows the six ASCII blanks only."""
    octets = (text or "").encode("utf-8", "surrogatepass")
    words = octets.split()
    lines = [line for line in octets.split(b"\n") if _WORD.search(line)]
    return (
        len(words),
        len(octets) - _count(octets, _CONTINUED) - _count(octets, _BLANKS),
        _count(octets, _NO_SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        _count(octets, _UPPER),
        _count(octets, _MARKS),
    )


def stats_of(text: Column) -> Column:
    """The counts as a struct of longs; NULL is an empty text."""

    @F.arrow_udf(", ".join(f"{name} long" for name in FIELDS))
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([text_stats(t) for t in batch.to_pylist()], dtype=np.int64)
            rows = rows.reshape(len(batch), len(FIELDS))
            yield pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(FIELDS))],
                list(FIELDS),
            )

    return count(text)
