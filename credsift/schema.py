"""The findings schema and the tool registry order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Report column names, in report order.
FINDING_COLUMNS = [
    "id",
    "repository",
    "file_path",
    "line_number",
    "secret_type",
    "secret_value",
    "commit_hash",
    "found_by",
]

FINDING_DDL = (
    "id STRING, repository STRING, file_path STRING, line_number INT, "
    "secret_type STRING, secret_value STRING, commit_hash STRING, found_by ARRAY<STRING>"
)

# The tools, in the order in which their findings arrive. Registered tools follow.
TOOLS = ["gitleaks", "trufflehog", "detect-secrets", "titus"]

# Arrival order of a finding. Only comparisons inside one repository matter, so a struct of
# (tool, report, position) is enough and no global numbering is ever needed.
SEQ_DDL = (
    "STRUCT<tool: INT, path: STRING, block: BIGINT, key: STRING, pos: BIGINT, sub: BIGINT>"
)


def arrival(
    tool: str, path: Column, block: Column, key: Column, pos: Column, sub: Column
) -> Column:
    """Arrival order as an orderable struct: tool, report, split, key, record, sub-record."""
    rank = TOOLS.index(tool) if tool in TOOLS else len(TOOLS)
    return F.struct(
        F.lit(rank).cast("int").alias("tool"),
        path.alias("path"),
        block.cast("bigint").alias("block"),
        key.alias("key"),
        pos.cast("bigint").alias("pos"),
        sub.cast("bigint").alias("sub"),
    )


def line_number(text: Column) -> Column:
    """Line text to INT; missing, zero and non-numeric lines are NULL."""
    return F.nullif(text.try_cast("int"), F.lit(0))


def empty_findings(spark: SparkSession, with_seq: bool = False) -> DataFrame:
    ddl = FINDING_DDL + (f", seq {SEQ_DDL}" if with_seq else "")
    return spark.createDataFrame([], ddl)
