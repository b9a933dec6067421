"""Report tables, file sinks and streaming ingest."""

import json

from credsift.operators import reports
from credsift.schema import FINDING_COLUMNS, FINDING_DDL, empty_findings
from credsift.streaming import ingest

ROWS = [
    ("aaa", "shop", "c.yml", 10, "AWS", "AK\n\"1\"", "abc", ["gitleaks", "trufflehog"]),
    ("bbb", "blog", "e.sh", 2, "PASS", "s3", "def", ["detect-secrets"]),
    ("ccc", "blog", "", None, "PASS", "s4", "", ["detect-secrets"]),
]


def findings(spark):
    return spark.createDataFrame(ROWS, FINDING_DDL)


def test_general_and_tool_tables(spark, tmp_path):
    out = str(tmp_path / "tables")
    reports.write_table_reports(findings(spark), out)
    general = spark.read.parquet(f"{out}/general")
    assert general.columns == FINDING_COLUMNS
    assert {r.found_by for r in general.collect()} == {"gitleaks, trufflehog", "detect-secrets"}
    by_tool = spark.read.parquet(f"{out}/by_tool")
    counts = {r.tab: r["count"] for r in by_tool.groupBy("tab").count().collect()}
    assert counts == {"Gitleaks": 1, "Trufflehog": 1, "Detect-secrets": 2}


def test_json_reports(spark, tmp_path):
    out = tmp_path / "json"
    reports.write_json_reports(findings(spark), str(out))
    rows = [json.loads(line) for f in out.glob("report=blog/*.json") for line in f.open()]
    assert {r["id"] for r in rows} == {"bbb", "ccc"}
    assert spark.read.schema(FINDING_DDL).json(str(out)).count() == 3


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    out = str(tmp_path / "csv")
    reports.write_csv_report(findings(spark), out)
    back = spark.read.csv(out, header=True, multiLine=True, escape='"')
    assert "AK\n\"1\"" in {r.secret_value for r in back.collect()}


def test_empty_reports_keep_their_columns(spark, tmp_path):
    out = str(tmp_path / "none")
    reports.write_table_reports(empty_findings(spark), out)
    assert spark.read.parquet(f"{out}/general").columns == FINDING_COLUMNS
    assert reports.distinct_tools(empty_findings(spark)).count() == 0


def test_counts(spark):
    got = {r.tool: r.findings for r in reports.summary_by_tool(findings(spark)).collect()}
    assert got == {"gitleaks": 1, "trufflehog": 1, "detect-secrets": 2, "total": 3}
    none = reports.summary_by_tool(empty_findings(spark)).collect()
    assert [(r.tool, r.findings) for r in none] == [("total", 0)]
    stats = reports.reduction_stats(findings(spark), findings(spark).filter("id = 'aaa'"))
    assert {(r.repository, r.raw_findings, r.unique_findings) for r in stats.collect()} == {
        ("shop", 1, 1), ("blog", 2, 0)}


def test_ingest_merges_batches_and_repeats(spark, tmp_path):
    drop, state = tmp_path / "drop", str(tmp_path / "state")
    git = {"Data": {"Git": {"file": "s.py", "commit": "c", "line": 5}}}

    def put(repository, number, *secrets):
        folder = drop / repository
        folder.mkdir(parents=True, exist_ok=True)
        text = "\n".join(json.dumps({"SourceMetadata": git, "Raw": s}) for s in secrets)
        (folder / f"{number}_trufflehog_raw.json").write_text(text)

    def ingest_now():
        ingest.stream_reports(
            spark, "trufflehog", str(drop), state, str(tmp_path / "ckpt"), files_per_batch=1
        ).awaitTermination()

    put("r", 1, "one", "two")
    put("r", 2, "two")
    ingest_now()
    put("q", 3, "one two-three")
    put("r", 4, "key=one", "two")
    ingest_now()
    got = ingest.current_findings(spark, state).collect()
    assert {(r.repository, r.secret_value) for r in got} == {
        ("r", "two"), ("r", "key=one"), ("q", "one two-three")}


def test_stream_agrees_with_batch_and_survives_compaction(spark, tmp_path):
    """Names that need decoding, a second checkpoint over one state, and merged states."""
    from credsift.sources import landing, registry

    drop, state = tmp_path / "drop", str(tmp_path / "state")
    folder = drop / "my app+é"
    folder.mkdir(parents=True)
    (folder / "a_gitleaks_raw.json").write_text('[{"Secret": "one", "File": "f", "StartLine": 3}]')

    def ingest_now(checkpoint):
        ingest.stream_reports(
            spark, "gitleaks", str(drop), state, str(tmp_path / checkpoint)
        ).awaitTermination()

    ingest_now("first")
    for path in folder.iterdir():
        path.unlink()
    (folder / "b_gitleaks_raw.json").write_text('[{"Secret": "two", "File": "f", "StartLine": 4}]')
    ingest_now("second")  # begins at batch 0 again
    rows = lambda df: sorted(map(str, df.select(*FINDING_COLUMNS).collect()))
    streamed = rows(ingest.current_by_id(spark, state))
    assert len(streamed) == 2
    batch = registry.read_findings(landing.read_landing(spark, str(drop), ["gitleaks"]))
    assert set(rows(batch)) < set(streamed)
    for _ in range(2):
        ingest.compact(spark, state)
        assert rows(ingest.current_by_id(spark, state)) == streamed


def test_a_workspace_is_removed(spark):
    import os

    from credsift.session import cut, workspace

    with workspace(spark) as path:
        assert cut(findings(spark), "t").count() == 3
        assert os.path.isdir(path)
    assert not os.path.exists(path)
