"""Attribution of many findings: nothing of it passes through the driver or one task."""

from pyspark.sql import functions as F

from credsift.operators.attribution import attribute
from credsift.plans import inputs
from credsift.schema import FINDING_DDL


def test_no_side_is_broadcast(spark, tmp_path):
    findings = spark.createDataFrame(
        [("i", "r", "f", 5, "t", "s", "", ["titus"], "b")], FINDING_DDL + ", blob_id STRING"
    )
    blame = spark.createDataFrame(
        [("r", "c", "f", 1, 9, "x")],
        "repository STRING, revision STRING, file_path STRING, line_start INT, line_end INT, "
        "commit_hash STRING",
    )
    commits = spark.range(3).select(
        F.lit("r").alias("repository"), F.lit("b").alias("blob_id"),
        F.when(F.col("id") == 0, "c").otherwise("d").alias("commit_hash"),
        F.timestamp_seconds("id").alias("commit_ts"),
    )
    found = attribute(findings, blame, commits)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.commit_hash for r in found.collect()] == ["x"]


def test_part_keys_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(400).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet"
    )
    monkeypatch.setattr(inputs, "PARTS_A_TASK", 10)
    assert inputs.blob_commits(spark, str(tmp_path)).rdd.getNumPartitions() == 40
    assert inputs.blob_commits(spark, str(tmp_path)).count() == 400 * 24
    assert inputs.blame_ranges(spark, str(tmp_path)).rdd.getNumPartitions() == 40
