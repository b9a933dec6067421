"""Titus reports: an array of findings, each with matches; texts are base64.

A match names a blob, not a file. ``findings`` takes the blob paths as a table and leaves the
commit to the attribution operators; ``resolve`` fills the files in later.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.codec import base64_text
from credsift.functions.keys import finding_id
from credsift.functions.text import strip_space
from credsift.schema import FINDING_COLUMNS, arrival, line_number
from credsift.sources import json_parts as J
from credsift.sources import variants as V

TOOL = "titus"

# What a record says of its matches, and what stands in where it has none.
_NAMES = ("RuleName", "RuleID")
_LONE = (*_NAMES, "Groups")


def _places(skeleton: J.Skeleton, report) -> Iterator[J.Place]:
    if not isinstance(report, list):
        raise J.BrokenReport("not an array")
    for at, run, record in J.members(skeleton, report):
        if run:
            yield J.Place(None, at, run=run)
        else:
            yield from _record(skeleton, record, at)


def _record(skeleton: J.Skeleton, record, pos: int) -> Iterator[J.Place]:
    """The matches of a record with its names; one without matches or of another type is alone
    (no ``rule``)."""
    matches = record.get("Matches") if isinstance(record, dict) else None
    if not isinstance(record, dict):
        yield J.Place(None, pos, value=json.dumps(record))
    elif not isinstance(matches, list) or not matches:
        yield J.Place(None, pos, value=json.dumps({k: record[k] for k in _LONE if k in record}))
    else:
        rule = json.dumps({k: record[k] for k in _NAMES if k in record})
        for sub, run, match in J.members(skeleton, matches):
            yield J.Place(None, pos, sub, rule, run, None if run else json.dumps(match))


_NONE: dict = {}


def _plain(report) -> Iterator[J.Plain]:
    """Fields: encoded value, blob, line, rule; '' as blob of a record without matches."""
    if not isinstance(report, list):
        raise J.Unusual
    for pos, record in enumerate(report):
        yield from _fields(record, pos)


def _fields(record, pos: int = 0) -> list[J.Plain]:
    if type(record) is not dict:
        return [(None, pos, None, None, record, None)]
    text = J.plain_text
    name = text(record, "RuleName") or text(record, "RuleID", "Unknown")
    matches = record.get("Matches")
    if type(matches) is not list or not matches:
        groups = record.get("Groups")
        first = groups[0] if type(groups) is list and groups else None
        return [(None, pos, None, [text({"": first}, ""), "", None, name])]
    rows: list[J.Plain] = []
    rule = None
    for sub, match in enumerate(matches):
        if type(match) is dict:
            # a level that is absent is as good as one without members
            snippet = match.get("Snippet", _NONE)
            place = match.get("Location", _NONE)
            if type(place) is dict and place:
                place = place.get("Source", _NONE)
                if type(place) is dict and place:
                    place = place.get("Start", _NONE)
            if type(snippet) is dict and type(place) is dict:
                encoded = snippet.get("Matching")
                if type(encoded) is not str:
                    encoded = text(snippet, "Matching", None)
                blob = match.get("BlobID", "")
                if type(blob) is not str:
                    blob = text(match, "BlobID") or ""
                own = match.get("RuleName", "")
                if type(own) is not str:
                    own = text(match, "RuleName")
                line = text(place, "Line", None) if place else None
                rows.append((None, pos, sub, [encoded, blob, line, own or name]))
                continue
        rule = rule or json.dumps({k: record[k] for k in _NAMES if k in record})
        rows.append((None, pos, sub, None, match, rule))
    return rows


def parts(landing: DataFrame, usable: bool = True, unusable: bool = True) -> DataFrame:
    """The matches of all titus reports, records without any, and reports that cannot be used."""
    return J.parts(
        landing.filter(F.col("tool") == TOOL),
        J.Shape(4, _places, 2, _record, _plain, _fields),
        usable=usable,
        unusable=unusable,
    )


def _matches(parts: DataFrame) -> DataFrame:
    """One row per match, and one (``lone``) per record without any, with the rule's name; reports that
    cannot be used are no usable rows.

    ``usable`` tells whether every level of the match that is present is an object.
    """
    value, around = F.col("value"), F.col("around")
    rows = V.once(
        parts.withColumn("lone", F.col("sub").isNull()),
        value=F.when(J.is_part(), F.try_parse_json("text")),
        around=F.try_parse_json(F.coalesce("rule", "text")),
    )
    usable = V.is_object(value)
    for path in ("$.Snippet", "$.Location", "$.Location.Source", "$.Location.Source.Start"):
        usable = usable & (F.col("lone") | V.absent_or_object(value, path))
    name = F.coalesce(
        F.nullif(V.text(around, "RuleName"), F.lit("")), V.text(around, "RuleID", "Unknown")
    )
    return V.once(rows, name=name, usable=J.is_plain() | F.coalesce(usable, F.lit(False)))


def _decoded(df: DataFrame, encoded: Column) -> DataFrame:
    """Add the decoded ``secret_value`` and drop rows where it is empty."""
    df = V.once(df, encoded=encoded)
    df = V.once(df, secret_value=strip_space(base64_text(F.col("encoded"))))
    return df.drop("encoded").filter(F.col("secret_value") != "")


def _located(parts: DataFrame) -> DataFrame:
    """All titus findings, file and commit still blank, with the blob of each match (``blob_id``).

    A record without matches has its first group as the value and no location (``lone``).
    """
    match, lone = F.col("value"), F.col("lone")
    return (
        _decoded(
            _matches(parts).filter("usable"),
            J.field(
                0,
                F.when(
                    lone, F.get(V.items(match, "Groups"), F.lit(0)).try_cast("string")
                ).otherwise(F.try_variant_get(match, "$.Snippet.Matching", "string")),
            ),
        )
        .select(
            "repository",
            F.lit("").alias("file_path"),
            J.field(
                1,
                F.when(lone, F.lit("")).otherwise(
                    F.coalesce(F.try_variant_get(match, "$.BlobID", "string"), F.lit(""))
                ),
            ).alias("blob_id"),
            line_number(
                J.field(2, F.try_variant_get(match, "$.Location.Source.Start.Line", "string"))
            ).alias("line_number"),
            J.field(
                3,
                F.when(lone, F.col("name")).otherwise(
                    F.coalesce(F.nullif(V.text(match, "RuleName"), F.lit("")), F.col("name"))
                ),
            ).alias("secret_type"),
            "secret_value",
            F.lit("").alias("commit_hash"),
            F.array(F.lit(TOOL)).alias("found_by"),
            arrival(
                TOOL, F.col("path"), F.lit(0), F.lit(""), F.col("pos"), F.coalesce("sub", F.lit(0))
            ).alias("seq"),
            "lone",
        )
        .withColumn("id", finding_id(*map(F.col, ("repository", "file_path", "secret_value"))))
        .select(*FINDING_COLUMNS, "seq", "blob_id", "lone")
    )


def unresolved(parts: DataFrame) -> DataFrame:
    return _located(parts).drop("lone")


def resolve(found: DataFrame, blob_paths: DataFrame) -> DataFrame:
    """Findings with the file of their blob, from ``blob_paths`` (repository, blob_id, path)."""
    places = blob_paths.select("repository", "blob_id", "path").filter("blob_id <> ''")
    return (
        found.join(places, ["repository", "blob_id"], "left")
        .withColumn("file_path", F.coalesce("path", F.lit("")))
        .withColumn("id", finding_id(*map(F.col, ("repository", "file_path", "secret_value"))))
        .select(*found.columns)
    )


def group_findings(landing: DataFrame) -> DataFrame:
    """Findings without matches: the first group is the value, no location is known."""
    found = _located(parts(landing, unusable=False))
    return found.filter("lone").select(*FINDING_COLUMNS, "seq")


def findings_of(parts: DataFrame, blob_paths: DataFrame | None = None) -> DataFrame:
    found = unresolved(parts)
    return found if blob_paths is None else resolve(found, blob_paths)


def rejects_of(parts: DataFrame) -> DataFrame:
    return J.rejected(TOOL, _matches(parts), F.col("value"))


def findings(landing: DataFrame, blob_paths: DataFrame | None = None) -> DataFrame:
    """All titus findings, commits still blank, with their blobs."""
    return findings_of(parts(landing, unusable=False), blob_paths)


def rejects(landing: DataFrame) -> DataFrame:
    return rejects_of(parts(landing, usable=False))
