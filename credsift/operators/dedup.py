"""Three-pass deduplication of findings.

1. same ``id`` (repository, file, value without white space),
2. same repository and normal form, whatever the file,
3. overlapping values at one repository, file, line and commit.

Input: the finding columns plus ``seq``, any orderable column giving the arrival order inside
a repository. Every key holds the repository, so one run serves single repositories and the
whole estate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.operators.merge import cut_findings, merge_by, with_norm
from credsift.operators.proximity import absorb_overlapping
from credsift.schema import FINDING_COLUMNS
from credsift.session import cut


def merge_same_id(findings: DataFrame) -> DataFrame:
    return merge_by(with_norm(findings), "id")


def merge_same_secret(findings: DataFrame) -> DataFrame:
    """Needs the normal form of the surviving row, as one id can cover two normal forms."""
    if "norm" not in findings.columns:
        findings = with_norm(findings)
    return merge_by(findings, "repository", "norm")


def dedup_findings(findings: DataFrame, keep_seq: bool = False) -> DataFrame:
    """All three passes. The second pass is written out once: pass 3 measures it first."""
    merged = cut_findings(merge_same_secret(merge_same_id(findings)), "merged")
    unique = absorb_overlapping(merged)
    return unique.select(*FINDING_COLUMNS, *(["seq"] if keep_seq else []))


def dedup_with_stats(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings of ``dedup_findings``, and raw and unique counts per repository.

    The number of raw findings is carried through the passes, so the findings are read once.
    """
    counted = with_norm(findings.withColumn("raw", F.lit(1).cast("bigint")))
    first = merge_by(counted, "id", sums=("raw",))
    merged = cut_findings(merge_by(first, "repository", "norm", sums=("raw",)), "merged")
    unique = cut(absorb_overlapping(merged.drop("raw")).select(*FINDING_COLUMNS), "unique")
    before = merged.groupBy("repository").agg(F.sum("raw").alias("raw_findings"))
    after = unique.groupBy("repository").agg(F.count("*").alias("unique_findings"))
    return unique, before.join(after, "repository")
