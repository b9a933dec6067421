"""Absorption of overlapping values at one source location.

At each location the longest value comes first; a later value whose core lies inside an
earlier survivor joins it, and a survivor whose core lies inside a later value joins forces
with that value. The longer value is always the one kept, the tools are united.

Locations of a few values are folded in order inside one array. In larger ones the overlaps are
found first, and only values that overlap, directly or over others, are folded together; the
result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.keys import LOCATION, given_id, has_location, id_again, location_hash
from credsift.functions.text import core_form, normal_form, overlaps
from credsift.operators.overlaps import absorb_linked
from credsift.session import cut

# A location is folded in one array up to this many values and characters. A single value has
# nothing to meet, however long it is.
FOLD_ROWS = 256
FOLD_CHARS = 4_000_000


def absorb_overlapping(
    findings: DataFrame,
    use_core: bool = True,
    fold_rows: int = FOLD_ROWS,
    fold_chars: int = FOLD_CHARS,
) -> DataFrame:
    """Absorb overlapping values per location; rows without a full location pass through.

    Needs ``seq`` and ids and normal forms that are unique per repository, as the second pass
    leaves them. ``use_core=False`` compares whole normal forms only. ``findings`` is read
    several times, so it should be a written table.
    """
    columns = findings.columns
    if "norm" not in columns:
        findings = findings.withColumn("norm", normal_form(F.col("secret_value")))
    core = core_form if use_core else lambda norm: norm
    elsewhere = findings.filter(~has_location()).select(*columns)
    located = findings.filter(has_location())

    # as a written table its size is known, so the joins below broadcast it only if it is small
    crowded = cut(_crowded_locations(located, fold_rows, fold_chars), "crowded")
    if crowded.isEmpty():
        return elsewhere.unionByName(_fold(located, core, columns))

    located = located.withColumn("_place", location_hash())
    quiet = located.join(crowded, "_place", "left_anti")
    busy = located.join(crowded, "_place", "left_semi").drop("_place")
    return elsewhere.unionByName(_fold(quiet, core, columns)).unionByName(
        absorb_linked(busy.withColumn("core", core(F.col("norm")))).select(*columns)
    )


def _crowded_locations(located: DataFrame, rows: int, chars: int) -> DataFrame:
    """Hashes of locations too large for one array; a numeric count with map-side sums."""
    return (
        located.groupBy(location_hash().alias("_place"))
        .agg(F.count("*").alias("_rows"), F.sum(F.length("norm")).alias("_chars"))
        .filter((F.col("_rows") > 1) & ((F.col("_rows") > rows) | (F.col("_chars") > chars)))
        .select("_place")
    )


def _fold(located: DataFrame, core: Callable[[Column], Column], columns: list[str]) -> DataFrame:
    # what the others of an item give is made again behind the shuffle
    keep = [c for c in columns if c not in ("norm", "found_by", "seq", "id", *LOCATION)]
    item = F.struct(
        (-F.length("norm")).alias("rank"),
        "seq",
        "norm",
        "found_by",
        F.struct(given_id().alias("given_id"), *keep).alias("row"),
    )
    groups = located.groupBy(*LOCATION).agg(F.array_sort(F.collect_list(item)).alias("items"))
    with_core = F.transform("items", lambda i: i.withField("core", core(i["norm"])))
    survivors = F.when(F.size("items") < 2, F.col("items")).otherwise(
        F.transform(_survivors(with_core), lambda i: i.dropFields("core"))
    )
    flat = groups.select(*LOCATION, F.explode(survivors).alias("item"))
    rows = flat.select(
        *LOCATION, "item.seq", *(F.col(f"item.row.{c}").alias(c) for c in ["given_id", *keep]),
        "item.norm", "item.found_by",
    )
    again = id_again(*map(F.col, ("given_id", "repository", "file_path", "secret_value")))
    return rows.withColumn("id", again).select(*columns)


def _survivors(items: Column) -> Column:
    """The ordered fold over one location."""
    return F.aggregate(items, F.slice(items, 1, 0), _place_item)


def _place_item(survivors: Column, item: Column) -> Column:
    touching = F.exists(
        survivors,
        lambda s: overlaps(item["core"], s["norm"]) | overlaps(s["core"], item["norm"]),
    )
    return F.when(~touching, F.array_append(survivors, item)).otherwise(
        F.aggregate(
            survivors,
            F.struct(
                F.slice(survivors, 1, 0).alias("kept"),
                item.alias("current"),
                F.lit(False).alias("placed"),
            ),
            _meet,
            lambda st: F.when(st["placed"], st["kept"]).otherwise(
                F.array_append(st["kept"], st["current"])
            ),
        )
    )


def _meet(state: Column, survivor: Column) -> Column:
    """Meet the next survivor: join it, take it over and go on, or pass by."""
    kept, current, placed = state["kept"], state["current"], state["placed"]

    def step(new_kept: Column, new_current: Column, now_placed: Column) -> Column:
        return F.struct(
            new_kept.alias("kept"), new_current.alias("current"), now_placed.alias("placed")
        )

    passed = step(F.array_append(kept, survivor), current, placed)
    joined = step(F.array_append(kept, _united(survivor, current)), current, F.lit(True))
    taken = step(kept, _united(current, survivor), F.lit(False))
    return (
        F.when(placed, passed)
        .when(overlaps(current["core"], survivor["norm"]), joined)
        .when(overlaps(survivor["core"], current["norm"]), taken)
        .otherwise(passed)
    )


def _united(first: Column, second: Column) -> Column:
    """The longer item, the first on equal length, with the tools of both."""
    longer = F.when(first["rank"] <= second["rank"], first).otherwise(second)
    tools = F.array_sort(F.array_union(first["found_by"], second["found_by"]))
    return longer.withField("found_by", tools)
