"""Overlapping values of one location, for locations of any size.

A value overlaps another one when its core is a piece of it. Pairs are never listed. Every core names
one of its grams, the one that fewest values of the location hold, and is tied to all values that
hold this gram; what holds a core holds its gram. Each value gives every gram once, however often it
repeats, so the work follows the length of the texts for repetitive values, too.

Values that are tied, directly or over others, form a component. That makes components no smaller
than overlaps do, and outcomes in one component do not depend on any other, so each is folded by
itself: its values come in order as a sorted stream, and only the survivors so far are held.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.functions.keys import LOCATION
from credsift.operators.components import components
from credsift.session import cut

GRAM = 8
# Gram rows that are handed on at once.
_ROWS = 1 << 16


def windows(text: str, size: int) -> np.ndarray:
    """A 64-bit number per distinct window of ``size`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - size + 1
    if n < 1 or size < 1:
        return np.zeros(0, dtype=np.int64)
    sums = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        sums = (sums ^ codes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(29)
    return np.unique(sums.view(np.int64))


def _grams(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(place, key, gram): the distinct grams of a text in the listed ``sizes``."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, own, value, sizes in zip(
                batch["place"], batch["own"], batch["value"], batch["sizes"], strict=True
            ):
                for size in sorted(sizes):
                    grams = windows(value, size)
                    for a in range(0, len(grams), _ROWS):
                        yield pd.DataFrame(
                            {"place": place, "own": own, "gram": grams[a : a + _ROWS]}
                        )

    return rows.select(
        "place", F.col(key).alias("own"), F.col(text).alias("value"), "sizes"
    ).mapInPandas(cut_up, "place long, own long, gram long")


def ties(values: DataFrame) -> DataFrame:
    """(u, v): a core's rarest gram beside each value that holds it, as numbers.

    ``values``: place, node, norm, core, with numbers for the place and the value; read several
    times, so it should be a written table.
    """
    size = F.least(F.length("core"), F.lit(GRAM))
    sizes = values.groupBy("place").agg(F.collect_set(size).alias("sizes"))
    held = cut(_grams(values.join(sizes, "place"), "node", "norm"), "overlap-grams")
    cores = (
        values.filter("core <> ''")
        .withColumn("sizes", F.array(size))
        .withColumn("key", F.xxhash64("core"))
        .dropDuplicates(["place", "key"])
    )
    rarest = (
        _grams(cores, "key", "core")
        .join(held.groupBy("place", "gram").agg(F.count("*").alias("n")), ["place", "gram"])
        .groupBy("place", "own")
        .agg(F.min(F.struct("n", "gram")).alias("rarest"))
        .select("place", F.col("rarest.gram").alias("gram"))
        .distinct()
    )
    tied = held.join(rarest, ["place", "gram"]).select(
        F.xxhash64("place", "gram").alias("u"), F.col("own").alias("v")
    )
    # an empty core lies in every value of its location
    open_places = values.filter("core = ''").select("place").distinct()
    return tied.union(
        values.join(open_places, "place").select(F.xxhash64("place").alias("u"), F.col("node"))
    )


# --- the fold --------------------------------------------------------------------------------

Item = tuple[str, str, str, Iterable[str]]  # id, norm, core, tools

# Survivors up to this number are compared one by one; beyond it an index finds candidates. Longer
# texts than ``_SHORT`` stay out of the index: values come longest first, so they are the early ones.
_FEW = 64
_SHORT = 1024
_ASKED = 16  # grams of a core that are looked up


def _pieces(text: str, size: int) -> set[str]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


class _Survivors:
    """Survivors in their order, with an index of their grams and one gram of each core."""

    def __init__(self) -> None:
        self.items: dict[int, tuple[str, str, str, set[str]]] = {}
        self.ticket = 0
        self.long: dict[int, None] = {}  # tickets of long texts and empty cores: always compared
        self.holds: dict[int, dict[str, list[int]]] = {}  # gram size -> gram -> tickets
        self.anchors: dict[int, dict[str, list[int]]] = {}

    def add(self, item: tuple[str, str, str, set[str]]) -> None:
        self.items[self.ticket] = item
        self._index(self.ticket, self.holds)
        _, norm, core, _ = item
        if core and len(norm) <= _SHORT:
            size = min(GRAM, len(core))
            at = (len(core) - size) // 2
            known = self.anchors.setdefault(size, {})
            known.setdefault(core[at : at + size], []).append(self.ticket)
        else:
            self.long[self.ticket] = None
        self.ticket += 1

    def _index(self, ticket: int, sizes: Iterable[int]) -> None:
        norm = self.items[ticket][1]
        if len(norm) <= _SHORT:
            for size in sizes:
                for gram in _pieces(norm, size):
                    self.holds[size].setdefault(gram, []).append(ticket)

    def remove(self, ticket: int) -> None:
        del self.items[ticket]
        self.long.pop(ticket, None)

    def around(self, norm: str, core: str, seen: int) -> Iterable[int]:
        """Tickets behind ``seen``, in order, that may hold ``core`` or have a core in ``norm``."""
        if len(self.items) <= _FEW or not core or len(norm) > _SHORT:
            return [t for t in self.items if t > seen]
        size = min(GRAM, len(core))
        if size not in self.holds:
            self.holds[size] = {}
            for ticket in self.items:
                self._index(ticket, [size])
        last = len(core) - size
        asked = {core[i : i + size] for i in range(0, last + 1, max(1, last // _ASKED))}
        found = set(min((self.holds[size].get(g, ()) for g in asked), key=len))
        for size, known in self.anchors.items():
            for gram in _pieces(norm, size):
                found.update(known.get(gram, ()))
        found.update(self.long)
        return sorted(t for t in found if t > seen and t in self.items)


def fold(items: Iterable[Item]) -> list[tuple[str, set[str]]]:
    """The ids of the survivors among items in order, with the tools of all they absorbed.

    Each item walks the survivors in their order. The first one that holds its core takes it in,
    and it stops there; one whose core it holds is taken along, and the longer of the two, the
    walker on equal length, walks on. What still walks at the end is the last survivor. An absorbed
    item is not held any longer.
    """
    survivors = _Survivors()
    for fid, norm, core, tools in items:
        walker, seen, placed = (fid, norm, core, set(tools)), -1, False
        ahead = iter(survivors.around(norm, core, seen))
        while not placed:
            ticket = next(ahead, None)
            if ticket is None:
                survivors.add(walker)
                break
            seen, survivor = ticket, survivors.items[ticket]
            if walker[2] in survivor[1]:
                survivor[3].update(walker[3])
                placed = True
            elif survivor[2] in walker[1]:
                survivors.remove(ticket)
                both = walker[3] | survivor[3]
                longer = walker if len(walker[1]) >= len(survivor[1]) else survivor
                if longer is survivor:
                    ahead = iter(survivors.around(survivor[1], survivor[2], seen))
                walker = (*longer[:3], both)
    return [(item[0], item[3]) for item in survivors.items.values()]


def _fold_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, all_tools) of the survivors of rows sorted by (root, order)."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def components_() -> Iterator[Iterator[Item]]:
        stream = rows()
        ahead = next(stream, None)
        while ahead is not None:
            root = ahead["root"]

            def own() -> Iterator[Item]:
                nonlocal ahead
                while ahead is not None and ahead["root"] == root:
                    yield ahead["id"], ahead["norm"], ahead["core"], ahead["found_by"]
                    ahead = next(stream, None)

            yield own()

    held: list[tuple[str, set[str]]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in held], pa.string()),
             pa.array([sorted(t) for _, t in held], pa.list_(pa.string()))],
            names=["id", "all_tools"],
        )

    for items in components_():
        held += fold(items)
        if len(held) >= _ROWS:
            yield batch()
            held = []
    yield batch()


def absorb_linked(findings: DataFrame) -> DataFrame:
    """Absorb overlapping values per location. Needs ``id, seq, norm, core`` and a location."""
    # numbers are enough to tie: equal ones of two values would only join two components
    numbered = findings.withColumn(
        "place", F.xxhash64(F.to_json(F.struct(*LOCATION)))
    ).withColumn("node", F.xxhash64(F.lit("value"), "id"))
    values = cut(numbered, "overlap-values")
    labels = cut(components(ties(values)), "overlap-components")
    # every component lies in one partition, its values in the order of the fold
    ordered = (
        values.select("id", "seq", "norm", "core", "found_by", "node")
        .join(labels, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .repartition("root")
        .sortWithinPartitions("root", F.desc(F.length("norm")), "seq", "id")
        .select("root", "id", "norm", "core", "found_by")
    )
    kept = ordered.mapInArrow(_fold_stream, "id string, all_tools array<string>")
    return (
        values.join(kept, "id")
        .withColumn("found_by", F.col("all_tools"))
        .drop("all_tools", "place", "core", "node")
    )
