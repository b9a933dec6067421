"""Merging findings that share a key into one.

Every aggregate here is a minimum over an orderable struct (or a set union), so it combines
map-side, has a state of one record per key however many rows share the key, and can be
resumed from stored partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.keys import given_id, has_location, id_again, short_id
from credsift.functions.text import normal_form
from credsift.session import cut

_ROW = ["repository", "file_path", "line_number", "secret_type", "secret_value", "commit_hash"]


def with_norm(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", normal_form(F.col("secret_value")))


def preference() -> Column:
    """Smallest is best: file, then commit, then line present, then the longest normal form."""
    blank_file = (F.coalesce(F.col("file_path"), F.lit("")) == "").cast("bigint")
    blank_commit = (F.coalesce(F.col("commit_hash"), F.lit("")) == "").cast("bigint")
    blank_line = F.col("line_number").isNull().cast("bigint")
    blanks = blank_file * 4 + blank_commit * 2 + blank_line
    return blanks * F.lit(1 << 32) - F.length("norm")


def start_state(df: DataFrame) -> DataFrame:
    """One mergeable state per finding: best row, first commit, first line, tools, order.

    A complete row needs no filling and, if a group has one, is its best row. So complete rows
    offer no commit or line to others, which keeps most states small. For the same end they hold an
    id only where it does not follow from the row, and its beginning, which decides between rows of
    one ``seq``.
    """
    incomplete = ~has_location()
    commit, line = F.col("commit_hash"), F.col("line_number")
    return df.select(
        "*",
        F.struct(
            preference().alias("preference"),
            "seq",
            F.left("id", F.lit(8)).alias("id_start"),
            given_id().alias("given_id"),
            *_ROW,
        ).alias("best"),
        F.when(incomplete & (commit != ""), F.struct("seq", "commit_hash")).alias("first_commit"),
        F.when(incomplete & line.isNotNull(), F.struct("seq", "line_number")).alias("first_line"),
    )


def combine_states(df: DataFrame, *keys: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Combine states per key; ``seq`` of the result is that of the first finding.

    ``sums`` names further columns that are added up.
    """
    return df.groupBy(*(short_id().alias("id") if k == "id" else k for k in keys)).agg(
        F.min("best").alias("best"),
        F.min("first_commit").alias("first_commit"),
        F.min("first_line").alias("first_line"),
        F.min("seq").alias("seq"),
        union_of_tools("found_by").alias("found_by"),
        *(F.sum(c).alias(c) for c in sums),
    )


def union_of_tools(column: str) -> Column:
    """Sorted union of tool lists. The set holds distinct lists, a handful at most."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def finish_state(df: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """States to findings: the best row, blanks filled field by field from the first bearer."""
    best = F.col("best")
    return df.select(
        id_again(
            best["given_id"], best["repository"], best["file_path"], best["secret_value"]
        ).alias("id"),
        best["repository"].alias("repository"),
        best["file_path"].alias("file_path"),
        F.coalesce(best["line_number"], F.col("first_line.line_number")).alias("line_number"),
        best["secret_type"].alias("secret_type"),
        best["secret_value"].alias("secret_value"),
        F.coalesce(
            F.nullif(best["commit_hash"], F.lit("")), F.col("first_commit.commit_hash"), F.lit("")
        ).alias("commit_hash"),
        "found_by",
        "seq",
        *sums,
    )


def merge_by(df: DataFrame, *keys: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Merge all findings with equal keys. Needs ``seq`` and ``norm``; norm is made anew."""
    return with_norm(finish_state(combine_states(start_state(df), *keys, sums=sums), sums))


def cut_findings(df: DataFrame, label: str) -> DataFrame:
    """``cut`` of findings, whose ids are made again when they are read."""
    rows = df.withColumn("id", given_id())
    written = cut(rows, label, compression="zstd")
    again = id_again(*map(F.col, ("id", "repository", "file_path", "secret_value")))
    return written.withColumn("id", again).select(*df.columns)
