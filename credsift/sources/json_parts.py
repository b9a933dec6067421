"""Whole JSON documents of any size, element by element.

A report is one JSON value that holds a list of findings, or lists of them one level further down.
Its elements are cut out of the text by their depth alone, so nothing larger than one element is
ever parsed. What is left is the skeleton: the report with a short mark in place of each run of
elements. Parsing the skeleton checks the rest of the text and tells where every run belongs.

Reports lie in the landing table as one row, or as chunks that end behind a ``}``. A report in
chunks is read by as many tasks:

1. each chunk tells how it changes the state (in a string or not, and the depth) from either start;
   a running sum over these few numbers gives every chunk its start;
2. each chunk gives its complete elements (and records of them) and its skeleton. An element that
   crosses chunks stays in the skeletons as it is;
3. a report's skeletons, a small part of its text, are put together and parsed, and give the runs
   their places.

A report counts as a whole or not at all: if the skeleton or an element is broken, it gives one row
that says so and where.

Most reports are small and as usual. Those of up to ``SMALL`` bytes are parsed once, and the fields of
their usable elements are taken as they are (``plain``). Elements that cannot be used, and all of a
report with anything unusual in it, take the way above.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credsift.session import cut

# One row per element ("part") or per report that cannot be used ("report"):
# key: the list's name where lists have one; pos, sub: the element's place; text: its JSON;
# rule: what the element around it says of it; reason, at: the fault and its byte.
PARTS_DDL = (
    "repository STRING, path STRING, kind STRING, key STRING, pos BIGINT, sub BIGINT, "
    "text STRING, rule STRING, reason STRING, at BIGINT"
)
# plain: the fields of a usable element, in the order of its tool, in place of ``text``
READ_DDL = PARTS_DDL + ", plain ARRAY<STRING>"

# Bytes of a report that may be parsed in one piece.
SMALL = 64 << 10

# Bytes of a value that are looked at together; a value is cut behind the next ``}``.
WINDOW = 4 << 20
NEAR = 128 << 10

# the next bracket, past whole strings, or the quote of a string that does not end
_TOKEN = re.compile(rb'(?:[^"{}\[\]]++|"(?:[^"\\]++|\\.)*+")*+([{}\[\]"]|\Z)', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]++|\\.)*+("?)', re.S)


class BrokenReport(Exception):
    def __init__(self, reason: str, at: int | None = None):
        super().__init__(reason)
        self.reason, self.at = reason, at


@dataclass
class State:
    """Where a walk through a text stands."""

    inside: bool = False
    depth: int = 0


def walk(data: bytes, state: State, level: int = 0) -> tuple[list[tuple[int, int]], State]:
    """The objects of depth ``level`` that begin and end in ``data``, and the state behind it."""
    found: list[tuple[int, int]] = []
    depth, inside, at, start = state.depth, False, 0, None
    if state.inside:
        match = _STRING_END.match(data)
        at, inside = match.end(), not match[1]
    for match in _TOKEN.finditer(data, at) if not inside else ():
        byte = match[1]
        if byte == b"{" or byte == b"[":
            depth += 1
            if depth == level:
                start = match.end() - 1 if byte == b"{" else None
        elif byte == b'"':
            inside = True
            break
        elif byte:
            if depth == level and start is not None:
                found.append((start, match.end()))
                start = None
            depth -= 1
    return found, State(inside, depth)


_CHANGE = np.zeros(256, np.int8)
_CHANGE[list(b"{[")], _CHANGE[list(b"}]")] = 1, -1


def _quoted(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(offset, bytes without escaped quotes, 1 for those behind an odd number of quotes, backslashes)
    of windows that fit into a processor's cache."""
    for at, window in windows(data, NEAR):
        plain = window.replace(b"\\\\", b"\\_").replace(b'\\"', b"\\_")
        octets = np.frombuffer(plain, np.uint8)
        odd = np.cumsum(octets == ord('"'), dtype=np.uint8) & 1
        yield at, octets, odd, octets == ord("\\") if b"\\" in plain else None


def states_behind(data: bytes) -> list[State]:
    """The states behind ``data`` that begins outside and inside of a string, as ``walk`` gives them.

    The bytes behind an odd number of quotes are strings from the one start, the others from the other.
    """
    turned, depths, bad = 0, [0, 0], [False, False]
    for _, octets, odd, slashes in _quoted(data):
        change = _CHANGE[octets]
        whole, at_odd = int(change.sum(dtype=np.int64)), int((change * odd).sum(dtype=np.int64))
        for start in (0, 1):
            outside = start ^ turned
            depths[start] += at_odd if outside else whole - at_odd
            if slashes is not None:
                bad[start] = bad[start] or bool((slashes & (odd == outside)).any())
        turned ^= int(odd[-1]) if odd.size else 0
    # a backslash outside of strings: not JSON, or the other start holds
    return [
        walk(data, State(bool(start)))[1] if bad[start] else State(bool(start ^ turned), depths[start])
        for start in (0, 1)
    ]


def objects(data: bytes, state: State, level: int) -> list[tuple[int, int]]:
    """The objects of depth ``level`` that begin and end in ``data``, as ``walk`` gives them."""
    outside, places, bytes_ = int(state.inside), [], []
    for offset, octets, odd, slashes in _quoted(data):
        if slashes is not None and (slashes & (odd == outside)).any():  # not JSON
            return walk(data, state, level)[0]
        found = np.flatnonzero((_CHANGE[octets] != 0) & (odd == outside))
        places.append(found + offset)
        bytes_.append(octets[found])
        outside ^= int(odd[-1]) if odd.size else 0
    at, byte = np.concatenate(places), np.concatenate(bytes_)
    step = _CHANGE[byte]
    depth = state.depth + np.cumsum(step, dtype=np.int64)
    edge = depth == np.where(step > 0, level, level - 1)  # begins and ends by turns
    at, byte, step = at[edge], byte[edge], step[edge]
    first = np.flatnonzero(step[:-1] > 0)
    first = first[byte[first] == ord("{")]
    return list(zip(at[first].tolist(), (at[first + 1] + 1).tolist(), strict=True))


def parsed(data: bytes, at: int = 0):
    """The JSON value; ``at`` is the byte where ``data`` begins in its report."""
    try:
        return json.loads(data.decode("utf-8"))
    except json.JSONDecodeError as err:
        ahead = len(err.doc[: err.pos].encode("utf-8", "replace"))
        raise BrokenReport("broken json", at + ahead) from None
    except (UnicodeDecodeError, RecursionError):
        raise BrokenReport("broken json", at) from None


@dataclass
class Skeleton:
    """A text without its elements; ``starts`` maps its bytes back to the report."""

    mark: str
    pieces: list[bytes] = field(default_factory=list)
    starts: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def put(self, piece: bytes, at: int) -> None:
        if piece:
            self.starts.append((self.size, at))
            self.pieces.append(piece)
            self.size += len(piece)

    def run(self, chunk: int, first: int, last: int, at: int) -> None:
        self.put(b'{"%s":[%d,%d,%d]}' % (self.mark.encode(), chunk, first, last), at)

    def value(self):
        try:
            return parsed(b"".join(self.pieces))
        except BrokenReport as err:
            near = [(s, a) for s, a in self.starts if s <= (err.at or 0)]
            start, at = near[-1] if near else (0, 0)
            raise BrokenReport(err.reason, at + (err.at or 0) - start) from None

    def run_of(self, value) -> list[int] | None:
        """(chunk, first, last) if the value is a run of elements that were cut out."""
        return value.get(self.mark) if isinstance(value, dict) and len(value) == 1 else None


def cut_out(
    data: bytes, found: list[tuple[int, int]], skeleton: Skeleton, chunk: int, number: int, at: int
) -> list[int]:
    """Put ``data`` without the elements at ``found`` into the skeleton; ``number`` is the first
    one's. Elements with only a comma between them are one run; returns the first of each run."""
    before, first = 0, 0
    firsts: list[int] = []

    def close(last: int) -> None:
        firsts.append(number + first)
        skeleton.run(chunk, number + first, number + last, at + found[first][0])

    for i, (begin, end) in enumerate(found):
        if i and data[before:begin].strip(b" \t\r\n") != b",":
            close(i - 1)
            first = i
        if i == first:
            skeleton.put(data[before:begin], at + before)
        before = end
    if found:
        close(len(found) - 1)
    skeleton.put(data[before:], at + before)
    return firsts


def windows(data: bytes, size: int = WINDOW) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces of about ``size`` that end behind a ``}``."""
    begin = 0
    while len(data) - begin > size:
        end = data.find(b"}", begin + size) + 1
        if not end:
            break
        yield begin, data[begin:end]
        begin = end
    yield begin, data[begin:] if begin else data


@dataclass
class Place:
    """A run of elements, or one that stayed in the skeleton, with its place in the report."""

    key: str | None
    pos: int
    sub: int | None = None
    rule: str | None = None
    run: list[int] | None = None
    value: str | None = None

    def element(self, i: int) -> tuple[int, int | None]:
        """(pos, sub) of the i-th element of the run; the finer number counts."""
        return (self.pos + i, None) if self.sub is None else (self.pos, self.sub + i)


# key, pos, sub and the fields; None, the value and the rule in place of the fields of one that cannot be used
Plain = tuple


class Unusual(Exception):
    """A report whose elements are to be read from their texts."""


def plain_text(holder: dict, name: str, default: str | None = "") -> str | None:
    """A member as ``variants.text`` gives it, where it is a text, a number without fraction, or null."""
    value = holder.get(name, default)
    if value is None or type(value) is str:
        return value
    if type(value) is int and -(10**15) < value < 10**15:
        return str(value)
    raise Unusual


def plain_texts(holder: dict, names: tuple[tuple[str, str], ...]) -> list[str | None]:
    """Members as ``plain_text`` gives them, by (name, default)."""
    found = [holder.get(*name) for name in names]
    for at, value in enumerate(found):
        if type(value) is not str and value is not None:
            found[at] = plain_text(holder, *names[at])
    return found


def _no_number(name: str) -> None:
    raise Unusual


_decode = json.JSONDecoder(parse_constant=_no_number).decode


def plain_elements(data: bytes, shape: Shape) -> list[Plain] | None:
    """The elements of a small report that is as usual; None for others."""
    # escaped surrogates may lack their partner
    if shape.plain is None or len(data) > SMALL or b"\\ud" in data or b"\\uD" in data:
        return None
    try:
        return list(shape.plain(_decode(data.decode("utf-8"))))
    except (ValueError, RecursionError, Unusual):
        return None


def _unique(pairs: list[tuple]) -> dict:
    holder = dict(pairs)
    if len(holder) != len(pairs):
        raise Unusual
    return holder


_decode_unique = json.JSONDecoder(object_pairs_hook=_unique).decode


def unfit_elements(data: bytes, shape: Shape, found: list[Plain]) -> Iterator[Row]:
    """The unusable ones among the elements of a small report, as ``elements`` gives them.

    The objects of depth ``level`` are the elements in their order, if there are as many of both and no
    name comes twice; otherwise ``Unusual``.
    """
    spans: Iterator[tuple[int, int]] | None = None
    if any(row[3] is None and type(row[4]) is dict for row in found):
        inner = [row for row in found if not shape.outer or row[2] is not None]
        objects = sum(row[3] is not None or type(row[4]) is dict for row in inner)
        cut_spans = walk(data, State(), shape.level)[0]
        if len(cut_spans) != objects:
            raise Unusual
        if any(row[0] is not None for row in found):
            _decode_unique(data.decode("utf-8"))
        spans = iter(cut_spans)
    for key, pos, sub, fields, *rest in found:
        is_object = fields is not None or type(rest[0]) is dict
        span = None
        if spans is not None and is_object and (not shape.outer or sub is not None):
            span = next(spans)
        if fields is None:
            value, rule = rest
            text = json.dumps(value) if span is None else data[span[0] : span[1]].decode()
            yield "part", key, pos, sub, text, rule, None, None if span is None else span[0]


def plain_record(text: bytes, shape: Shape) -> list[Plain] | None:
    """The elements of one small record that is as usual; None for others."""
    if shape.fields is None or len(text) > SMALL or b"\\ud" in text or b"\\uD" in text:
        return None
    try:
        return shape.fields(_decode(text.decode("utf-8")))
    except (ValueError, RecursionError, Unusual):
        return None


@dataclass(frozen=True)
class Shape:
    """How the reports of a tool are cut.

    ``places`` goes from a skeleton and its value to the places of all elements, in order. With
    ``outer``, whole records (objects of that depth) inside a chunk are cut where they lie, and
    ``record`` gives the places of one of them, so that the skeleton of a report in chunks holds
    no more than the records that cross chunks.

    ``plain`` goes from the value of a report to (key, pos, sub, fields) of each element, or (key, pos,
    sub, None, value, rule) of one that cannot be used; it raises ``Unusual`` where texts have to be
    looked at. ``fields`` does so for one record, or one element where ``outer`` is 0; its keys and
    positions do not count.
    """

    level: int
    places: Callable[[Skeleton, object], Iterator[Place]]
    outer: int = 0
    record: Callable[[Skeleton, object, int], Iterator[Place]] | None = None
    plain: Callable[[object], Iterator[Plain]] | None = None
    fields: Callable[[object], list[Plain]] | None = None


def members(skeleton: Skeleton, value: list) -> Iterator[tuple[int, list[int] | None, object]]:
    """(number, run, member) of the members of a list; a run stands for several."""
    at = 0
    for member in value:
        run = skeleton.run_of(member)
        yield at, run, member
        at += run[2] - run[1] + 1 if run else 1


Row = tuple[str, str | None, int | None, int | None, str | None, str | None, str | None, int | None]


def elements(
    data: bytes,
    level: int,
    places: Callable[[Skeleton, object], Iterator[Place]],
    mark: str,
    at: int = 0,
    size: int = WINDOW,
) -> Iterator[Row]:
    """The elements of one text, once all of it has been checked."""
    skeleton, state = Skeleton(mark), State()
    spans: list[tuple[int, int]] = []
    for offset, window in windows(data, size):
        found, state = walk(window, state, level)
        cut_out(window, found, skeleton, 0, len(spans), at + offset)
        spans += [(offset + a, offset + b) for a, b in found]
    placed = list(places(skeleton, skeleton.value()))
    for begin, end in spans:
        parsed(data[begin:end], at + begin)
    for place in placed:
        if place.run is None:
            yield "part", place.key, place.pos, place.sub, place.value, place.rule, None, None
            continue
        _, first, last = place.run
        for i in range(first, last + 1):
            begin, end = spans[i]
            pos, sub = place.element(i - first)
            text = data[begin:end].decode()
            yield "part", place.key, pos, sub, text, place.rule, None, at + begin


def _whole(shape: Shape, mark: str, size: int, usable: bool, unusable: bool) -> Callable:
    """Rows of reports that are one row each."""

    def texts_of(data: bytes) -> Iterator[tuple]:
        try:
            for row in elements(data, shape.level, shape.places, mark, 0, size):
                yield *row, None
        except BrokenReport as err:  # before the first element
            text = data.decode("utf-8", "replace")
            yield "report", None, None, None, text, None, err.reason, err.at, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports = batch.column("octets").to_pylist()
            taken = _Taken(batch)
            others: list[tuple[int, list[Row] | None]] = []
            for at, data in enumerate(reports):
                found = plain_elements(data or b"", shape)
                if found is None:
                    others.append((at, None))
                    continue
                if unusable and any(row[3] is None for row in found):
                    try:
                        others.append((at, list(unfit_elements(data, shape, found))))
                    except Unusual:
                        others.append((at, None))
                        continue
                if usable:
                    taken.add(at, found, len(data))
                    if taken.full():
                        yield taken.batch()
                        taken = _Taken(batch)
            yield taken.batch()
            names = zip(*(batch.column(c).to_pylist() for c in ("repository", "path")), strict=True)
            names = list(names) if others else []
            yield from _batches(
                (
                    (*names[at], *row)
                    for at, unfit in others
                    for row in (
                        texts_of(reports[at] or b"")
                        if unfit is None
                        else ((*row, None) for row in unfit)
                    )
                ),
                READ_DDL,
            )

    return read


class _Taken:
    """Plain elements of the reports of a batch, column by column."""

    def __init__(self, batch: pa.RecordBatch):
        self.of, self.size = batch, 0
        self.report: list[int] = []
        self.key: list[str | None] = []
        self.pos: list[int] = []
        self.sub: list[int | None] = []
        self.ends, self.fields = [0], []

    def add(self, report: int, found: list[Plain], size: int) -> None:
        self.size += size
        ends, flat = self.ends, self.fields
        for row in found:
            fields = row[3]
            if fields is not None:
                self.report.append(report)
                self.key.append(row[0])
                self.pos.append(row[1])
                self.sub.append(row[2])
                flat += fields
                ends.append(len(flat))

    def full(self) -> bool:
        return len(self.pos) >= _ROWS or self.size > _BYTES

    def batch(self) -> pa.RecordBatch:
        rows, text, number = len(self.pos), pa.string(), pa.int64()
        report = pa.array(self.report, number)
        columns = {
            "repository": self.of.column("repository").take(report).cast(text),
            "path": self.of.column("path").take(report).cast(text),
            "kind": pa.repeat(pa.scalar("part"), rows),
            "key": pa.array(self.key, text),
            "pos": pa.array(self.pos, number),
            "sub": pa.array(self.sub, number),
            "text": pa.nulls(rows, text),
            "rule": pa.nulls(rows, text),
            "reason": pa.nulls(rows, text),
            "at": pa.nulls(rows, number),
            "plain": pa.ListArray.from_arrays(
                pa.array(self.ends, pa.int32()), pa.array(self.fields, text)
            ),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_ROWS, _BYTES = 10_000, 8 << 20
_TYPES = {
    "STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary(),
    "ARRAY<ARRAY<BIGINT>>": pa.list_(pa.list_(pa.int64())), "ARRAY<STRING>": pa.list_(pa.string()),
}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of rows and bytes."""
    names, kinds = zip(*(c.split(" ") for c in ddl.split(", ")), strict=True)

    def batch(some: list[tuple]) -> pa.RecordBatch:
        columns = zip(*some, strict=True)
        arrays = [pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(names))

    texts = [at for at, kind in enumerate(kinds) if kind in ("STRING", "BINARY")]
    lists = [at for at, kind in enumerate(kinds) if kind == "ARRAY<STRING>"]
    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        for at in texts:
            if row[at]:
                size += len(row[at])
        for at in lists:
            if row[at]:
                size += sum(map(len, filter(None, row[at])))
        if len(some) == _ROWS or size > _BYTES:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


_STATE_DDL = (
    "path STRING, block BIGINT, pos BIGINT, size BIGINT, inside0 BOOLEAN, depth0 BIGINT, "
    "inside1 BOOLEAN, depth1 BIGINT"
)


def _states(chunks: DataFrame) -> DataFrame:
    """(path, block, pos, no, at, inside, depth, trim, short): how each chunk begins.

    The last chunk may have got a ``}`` too many when it was cut off; the rows without text behind a
    report tell its length.
    """

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    data = row["octets"] or b""
                    ends = states_behind(data)
                    yield (row["path"], row["block"], row["pos"], len(data),
                           *(x for e in ends for x in (e.inside, e.depth)))

        yield from _batches(rows(), _STATE_DDL)

    order = W.partitionBy("path").orderBy("block", "pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path")
    # a chunk keeps the state, turns it, or sets it; what counts is the last one that set it and
    # how many turned it since
    turns = F.when(~F.col("inside1") & F.col("inside0"), 1).otherwise(0)
    sets = F.when(
        F.col("inside0") == F.col("inside1"), F.struct("inside0", F.col("turned").alias("turned"))
    )
    set_ = F.last(sets, ignorenulls=True).over(before)
    since = F.coalesce(F.col("turned") - F.col("own"), F.lit(0)) - F.coalesce(
        F.col("set.turned"), F.lit(0)
    )
    return (
        cut(
            chunks.select("path", "block", "pos", F.col("value").cast("binary").alias("octets"))
            .mapInArrow(change, _STATE_DDL),
            "report-states",
        )
        .withColumn("no", F.row_number().over(order) - 1)
        .withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("own", turns)
        .withColumn("turned", F.sum("own").over(order))
        .withColumn("set", set_)
        .withColumn(
            "inside", (F.coalesce(F.col("set.inside0").cast("int"), F.lit(0)) + since) % 2 == 1
        )
        .withColumn("delta", F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0")))
        .withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
        .withColumn("rest", F.sum("size").over(whole) - F.max("block").over(whole))
        .withColumn("last", F.max(F.when(F.col("size") > 0, F.col("no"))).over(whole))
        .select(
            "path", "block", "pos", "no", "at", "inside", "depth",
            ((F.col("no") == F.col("last")) & (F.col("rest") == 1)).alias("trim"),
            (~F.col("rest").isin(0, 1)).alias("short"),
        )
    )


_PIECES_DDL = (
    "repository STRING, path STRING, no BIGINT, i BIGINT, sub BIGINT, text STRING, rule STRING, "
    "at BIGINT, ok BOOLEAN, plain ARRAY<STRING>, skeleton BINARY, starts ARRAY<ARRAY<BIGINT>>, "
    "first BIGINT"
)
_PLACES_DDL = "no BIGINT, first BIGINT, last BIGINT, " + PARTS_DDL


def _outside(data: bytes, start: State, records: list, shape: Shape) -> Iterator[tuple[int, int]]:
    """The objects of depth ``level`` that lie in no record."""
    at, state = 0, start
    for begin, end in [*records, (len(data), len(data))]:
        gap = data[at:begin]
        if state.inside or b"{" in gap:
            for a, b in walk(gap, state, shape.level)[0]:
                yield at + a, at + b
        at, state = end, State(False, shape.outer - 1)


# Bytes of neighbours that are parsed together.
TOGETHER = 256 << 10


def _values(data: bytes, found: list, firsts: set[int], shape: Shape) -> Iterator[dict | None]:
    """The values of the records of a chunk; None for those that have to be parsed one by one.

    Of a run only commas lie between, so neighbours in it are parsed as one list."""
    at = 0
    while at < len(found):
        begin, own = found[at][0][0], found[at][1]
        last = at + 1
        while (
            last < len(found) and last not in firsts and found[last][1] == own
            and found[last][0][1] - begin <= TOGETHER
        ):
            last += 1
        some, values = data[begin : found[last - 1][0][1]], None
        fits = shape.fields is not None and (own or not shape.outer)
        if fits and b"\\ud" not in some and b"\\uD" not in some:
            try:
                values = _decode("[" + some.decode("utf-8") + "]")
            except (ValueError, RecursionError, Unusual):
                pass
        if values is None or len(values) != last - at:
            values = [None] * (last - at)
        yield from values
        at = last


def _pieces(
    row: dict, shape: Shape, mark: str, usable: bool = True, unusable: bool = True
) -> Iterator[tuple]:
    """The elements and the skeleton of a chunk; ``first`` is the first element of an element's run."""
    at, start = row["at"], State(row["inside"], row["depth"])
    data = row["octets"] or b""
    data = data[:-1] if row["trim"] else data
    records = objects(data, start, shape.outer or shape.level)
    found = [(span, bool(shape.outer)) for span in records]
    if shape.outer:
        found += [(span, False) for span in _outside(data, start, records, shape)]
        found.sort()
    skeleton = Skeleton(mark)
    firsts = set(cut_out(data, [span for span, _ in found], skeleton, row["no"], 0, at))
    first = 0
    values = _values(data, found, firsts, shape)
    for i, (((begin, end), record), value) in enumerate(zip(found, values, strict=True)):
        first = i if i in firsts else first
        text = data[begin:end]
        plain = None
        if value is not None and end - begin <= SMALL:
            try:
                plain = shape.fields(value)
            except (ValueError, RecursionError, Unusual):
                pass
        elif record or not shape.outer:
            plain = plain_record(text, shape)
        if plain is not None and not (unusable and any(p[3] is None for p in plain)):
            for element in plain if usable else ():
                if element[3] is not None:
                    yield (i, element[2], None, None, at + begin, True, element[3], None, None,
                           first)
            continue
        try:
            if record:
                inner = elements(
                    text, shape.level - shape.outer + 1,
                    lambda s, value: shape.record(s, value, 0), mark, at + begin,
                )
                for _, _, _, sub, own, rule, _, where in inner:
                    yield i, sub, own, rule, where, True, None, None, None, first
            else:
                parsed(text, at + begin)
                yield i, None, text.decode(), None, at + begin, True, None, None, None, first
        except BrokenReport as err:
            yield i, None, None, None, err.at, False, None, None, None, first
    yield (None, None, None, None, at, not row["short"], None, b"".join(skeleton.pieces),
           [list(s) for s in skeleton.starts], None)


def _placed(row: dict, shape: Shape, mark: str) -> Iterator[tuple]:
    """The places of a report's runs and the elements that stayed in its skeletons."""
    skeleton = Skeleton(mark)
    for chunk in row["chunks"]:
        skeleton.starts += [(skeleton.size + s, a) for s, a in chunk["starts"]]
        skeleton.pieces.append(chunk["skeleton"])
        skeleton.size += len(chunk["skeleton"])
    try:
        if row["bad"] is not None:
            raise BrokenReport("broken json", row["bad"])
        for p in list(shape.places(skeleton, skeleton.value())):
            yield (*(p.run or (None, None, None)), row["repository"], row["path"], "part", p.key,
                   p.pos, p.sub, p.value, p.rule, None, None)
    except BrokenReport as err:
        yield (None, None, None, row["repository"], row["path"], "report", None, None, None, None,
               None, err.reason, err.at)


def _chunked(
    chunks: DataFrame, shape: Shape, mark: str, usable: bool, unusable: bool
) -> DataFrame:
    """Parts of reports that lie in several rows."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (row["repository"], row["path"], row["no"], *piece)
            for batch in batches
            for row in batch.to_pylist()
            for piece in _pieces(row, shape, mark, usable, unusable)
        )
        yield from _batches(rows, _PIECES_DDL)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for row in b.to_pylist() for r in _placed(row, shape, mark))
        yield from _batches(rows, _PLACES_DDL)

    pieces = cut(
        chunks.select(
            "repository", "path", "block", "pos", F.col("value").cast("binary").alias("octets")
        )
        .join(_states(chunks), ["path", "block", "pos"])
        .mapInArrow(take, _PIECES_DDL),
        "report-pieces",
    )
    skeletons = pieces.groupBy("repository", "path").agg(
        F.min(F.when(~F.col("ok"), F.col("at"))).alias("bad"),
        F.array_sort(
            F.collect_list(F.when(F.col("i").isNull(), F.struct("no", "skeleton", "starts")))
        ).alias("chunks"),
    )
    placed = cut(skeletons.mapInArrow(place, _PLACES_DDL), "report-places")
    # a chunk may hold thousands of runs, so every element meets its own one alone
    runs = placed.filter(F.col("no").isNotNull()).select(
        "path", "no", "first", "key", F.col("rule").alias("around"),
        F.col("pos").alias("pos0"), F.col("sub").alias("sub0"),
    )
    step = F.col("i") - F.col("first")
    flat = F.col("sub0").isNull()
    found = (
        pieces.filter(F.col("i").isNotNull() & F.col("ok"))
        .join(runs, ["path", "no", "first"])
        .select(
            "repository",
            "path",
            F.lit("part").alias("kind"),
            "key",
            F.when(flat, F.col("pos0") + step).otherwise(F.col("pos0")).alias("pos"),
            F.when(flat, F.col("sub")).otherwise(F.col("sub0") + step).alias("sub"),
            "text",
            F.coalesce("rule", "around").alias("rule"),
            F.lit(None).cast("string").alias("reason"),
            "at",
            "plain",
        )
    )
    others = placed.filter(F.col("no").isNull())
    others = others.withColumn("plain", F.lit(None).cast("array<string>"))
    return found.unionByName(others.select(*found.columns))


def in_chunks() -> Column:
    """Rows of reports that lie in several rows; their positions begin at 1."""
    return F.col("pos") > 0


def parts(
    reports: DataFrame,
    shape: Shape,
    size: int = WINDOW,
    usable: bool = True,
    unusable: bool = True,
) -> DataFrame:
    """The elements of all reports, and the reports that are broken (see ``READ_DDL``).

    ``reports`` are landing rows of one tool. Whoever asks for usable or unusable elements alone may
    still get others.
    """
    mark = uuid.uuid4().hex
    rows = reports.filter(~in_chunks()).select(
        "repository", "path", F.col("value").cast("binary").alias("octets")
    )
    whole = rows.mapInArrow(_whole(shape, mark, size, usable, unusable), READ_DDL)
    chunks = reports.filter(in_chunks())
    if chunks.isEmpty():
        return whole
    return whole.unionByName(_chunked(chunks, shape, mark, usable, unusable))


def is_part() -> Column:
    return F.col("kind") == "part"


def is_plain() -> Column:
    return F.col("plain").isNotNull()


def field(number: int, otherwise: Column) -> Column:
    """A field of a plain element; ``otherwise`` is how it is taken from the text of another."""
    return F.when(is_plain(), F.col("plain")[number]).otherwise(otherwise)


def rejected(tool: str, parts: DataFrame, value: Column) -> DataFrame:
    """Reports and elements that cannot be used, of parts with ``usable``. ``raw`` is NULL for a report
    in chunks, which the landing table keeps; ``path`` and ``at`` (the byte of the fault) point into
    it."""
    text = F.col("text")
    return parts.filter(~F.col("usable")).select(
        "repository",
        F.lit(tool).alias("tool"),
        F.when(is_part(), F.coalesce(F.to_json(value), text)).otherwise(text).alias("raw"),
        F.when(is_part(), F.lit("unusable record")).otherwise(F.col("reason")).alias("reason"),
        "path",
        "at",
    )
