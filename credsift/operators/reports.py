"""Report tables, counts and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.functions.text import tab_name
from credsift.schema import FINDING_COLUMNS


def general_report(findings: DataFrame) -> DataFrame:
    """All findings, tools as one text."""
    return findings.select(*FINDING_COLUMNS).withColumn(
        "found_by", F.array_join("found_by", ", ")
    )


def tool_reports(findings: DataFrame) -> DataFrame:
    """One row per finding and tool, with the name of the tool's report table."""
    return (
        findings.select(*FINDING_COLUMNS, F.explode("found_by").alias("tool"))
        .withColumn("tab", tab_name(F.col("tool")))
        .withColumn("found_by", F.array_join("found_by", ", "))
    )


def summary_by_tool(findings: DataFrame) -> DataFrame:
    """Findings per tool, a finding counting once for each of its tools, and the total."""
    marks = F.concat("found_by", F.array(F.lit("total")))
    counts = (
        findings.select(F.explode(marks).alias("tool"))
        .groupBy("tool")
        .agg(F.count("*").alias("findings"))
    )
    # a total of zero must show up as well
    nothing = findings.sparkSession.range(1).select(
        F.lit("total").alias("tool"), F.lit(0).cast("bigint").alias("findings")
    )
    return counts.unionByName(nothing).groupBy("tool").agg(F.sum("findings").alias("findings"))


def distinct_tools(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("found_by").alias("tool")).distinct()


def reduction_stats(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """Raw and unique findings per repository."""
    before = raw.groupBy("repository").agg(F.count("*").alias("raw_findings"))
    after = unique.groupBy("repository").agg(F.count("*").alias("unique_findings"))
    return before.join(after, "repository", "left").select(
        "repository",
        "raw_findings",
        F.coalesce("unique_findings", F.lit(0).cast("bigint")).alias("unique_findings"),
    )


def write_json_reports(findings: DataFrame, path: str) -> None:
    """Line-delimited JSON, one folder per repository; together they are the overall report.

    The rebalance hint gathers small repositories into few files and splits large ones.
    """
    (
        findings.select(*FINDING_COLUMNS, F.col("repository").alias("report"))
        .hint("rebalance", "report")
        .write.partitionBy("report")
        .mode("overwrite")
        .json(path)
    )


def write_table_reports(findings: DataFrame, path: str) -> None:
    """The general table and one table per tool, as Parquet."""
    general_report(findings).write.mode("overwrite").parquet(f"{path}/general")
    (
        tool_reports(findings)
        .hint("rebalance", "tab")
        .write.partitionBy("tab")
        .mode("overwrite")
        .parquet(f"{path}/by_tool")
    )


def write_csv_report(findings: DataFrame, path: str) -> None:
    """The general table as CSV; values may hold quotes and line breaks."""
    general_report(findings).write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).option("quoteAll", "true").csv(path)
