"""The stream against one batch over all reports, with look-ups that come late."""

import base64
import json

from credsift.operators.attribution import attribute
from credsift.operators.merge import merge_by, with_norm
from credsift.schema import FINDING_COLUMNS
from credsift.sources import landing, registry
from credsift.streaming import ingest


def _b64(text):
    return base64.b64encode(text.encode()).decode()


def _reports(n):
    git = {"Data": {"Git": {"file": "s.py", "commit": "c", "line": 5}}}
    return {
        "gitleaks": json.dumps([{"File": "a.py", "Secret": f"g{n}", "StartLine": 1}, 5]),
        "trufflehog": "\n".join(json.dumps({"SourceMetadata": git, "Raw": s}) for s in (f"t{n}", "t")),
        "detect-secrets": json.dumps({"results": {"d.py": [
            {"type": "T", "hashed_secret": "h", "line_number": n},
            {"type": "T", "hashed_secret": "h2", "line_number": 99}]}}),
        "titus": json.dumps([
            {"RuleID": f"r{n}", "Matches": [
                {"BlobID": f"b{n}", "Snippet": {"Matching": _b64("m")},
                 "Location": {"Source": {"Start": {"Line": 3}}}},
                {"BlobID": "gone", "Snippet": {"Matching": _b64("old")},
                 "Location": {"Source": {"Start": {"Line": 7}}}}]},
            {"Groups": [_b64("lone")]}]),
    }


def test_stream_equals_batch_for_all_tools(spark, tmp_path):
    drop, state = tmp_path / "drop", str(tmp_path / "state")

    def put(org, n):
        folder = drop / org / "api"
        folder.mkdir(parents=True, exist_ok=True)
        for tool, text in _reports(n).items():
            (folder / f"{n}_{landing.RAW_NAMES[tool]}").write_text(text)

    def ingest_now():
        for tool in _reports(0):
            ingest.stream_reports(
                spark, tool, str(drop), state, str(tmp_path / f"ckpt-{tool}"), files_per_batch=1,
                levels=2,
            ).awaitTermination()

    put("one", 1)
    put("two", 1)
    ingest_now()
    first = {r.secret_value for r in ingest.current_by_id(spark, state).collect()}
    assert first == {"g1", "t1", "t", "h", "h2", "m", "old", "lone"}
    put("one", 2)
    ingest_now()
    paths = spark.createDataFrame(
        [("one/api", "b1", "x.py"), ("one/api", "b2", "y.py"), ("two/api", "b1", "z.py"),
         ("one/api", "gone", "gone.py")],
        "repository STRING, blob_id STRING, path STRING",
    )
    lines = spark.createDataFrame(
        [("one/api", "d.py", 2, " pw = 1 "), ("two/api", "d.py", 1, "x")]
        + [("one/api", "d.py", n, "no") for n in range(1000, 1100)],
        "repository STRING, file_path STRING, line_number INT, line STRING",
    )
    blame = spark.createDataFrame(
        [("one/api", "HEAD", "x.py", 1, 9, "head"), ("one/api", "v1", "gone.py", 1, 9, "past")],
        "repository STRING, revision STRING, file_path STRING, line_start INT, line_end INT, "
        "commit_hash STRING",
    )
    commits = spark.createDataFrame(
        [("one/api", "gone", "v1", 1)],
        "repository STRING, blob_id STRING, commit_hash STRING, commit_ts INT",
    )
    lookups = {"titus": {"blob_paths": paths}, "detect_secrets": {"lines": lines}}
    found = registry.read_findings(landing.read_landing(spark, str(drop), levels=2), **lookups)
    batch = merge_by(with_norm(attribute(found, blame, commits)), "id")
    stream = ingest.current_by_id(spark, state, blame=blame, blob_commits=commits, **lookups)

    def rows(df):
        return sorted(map(str, df.select(*FINDING_COLUMNS).collect()))

    streamed = rows(stream)
    assert streamed == rows(batch)
    assert any("pw = 1" in r for r in streamed) and any("'past'" in r for r in streamed)
    ingest.compact(spark, state)
    assert rows(
        ingest.current_by_id(spark, state, blame=blame, blob_commits=commits, **lookups)
    ) == streamed
    assert ingest.current_findings(spark, state, **lookups).count() <= len(streamed)


def test_repositories_are_listed(spark, tmp_path):
    def found(levels=1):
        got = landing.discover_repositories(spark, str(tmp_path), levels).collect()
        return sorted((r.repository, r.path.removeprefix(str(tmp_path))) for r in got)

    assert found() == [(tmp_path.name, "")]
    for name in ("b app+é", "a", "org/deep", "no"):
        git = tmp_path / name / (".git" if name != "no" else "git")
        git.mkdir(parents=True)
        (git / "HEAD").write_text("ref: refs/heads/main")
        (git / "objects").mkdir()
        (git / "objects" / "x").write_text("x")
    (tmp_path / "worktree").mkdir()
    (tmp_path / "worktree" / ".git").write_text("gitdir: elsewhere")
    assert found() == [("a", "/a"), ("b app+é", "/b app+é")]
    assert found(2) == [("org/deep", "/org/deep")]
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("ref")
    assert found() == [(tmp_path.name, "")]


def test_reports_are_listed(spark, tmp_path):
    for repository in ("one", "two"):
        (tmp_path / repository).mkdir()
        (tmp_path / repository / f"{repository}_gitleaks_raw.json").write_text("[]")
    got = landing.list_reports(spark, str(tmp_path)).collect()
    assert sorted((r.repository, r.tool, r.length) for r in got) == [
        ("one", "gitleaks", 2), ("two", "gitleaks", 2)]
    assert landing.list_reports(spark, str(tmp_path / "none")).count() == 0


def test_only_wanted_rows_are_kept(spark):
    from pyspark.sql import functions as F

    from credsift.operators import prefilter

    rows = spark.range(200_000).select((F.col("id") % 7).cast("string").alias("f"), "id")
    keys = spark.range(0, 200_000, 97).select(
        (F.col("id") % 7).cast("string").alias("f"), F.col("id").cast("int").alias("id"))
    kept = prefilter.wanted_only(rows, keys, ["f", "id"])
    assert kept.columns == rows.columns
    assert kept.join(keys, ["f", "id"]).count() == keys.count()
    assert kept.count() < keys.count() + 0.05 * rows.count()
    assert prefilter.wanted_only(rows, keys.limit(0), ["f", "id"]).count() == 0
    before, prefilter.MOST_BITS = prefilter.MOST_BITS, 64
    try:
        assert prefilter.wanted_only(rows, keys, ["f", "id"]).count() == rows.count()
    finally:
        prefilter.MOST_BITS = before


def test_counts_come_from_the_passes(spark):
    from credsift.operators import dedup
    from credsift.plans import inputs

    found = inputs.lineitem_findings(spark, "/root/testdata/sf0.001")
    unique, stats = dedup.dedup_with_stats(found)
    rows = stats.collect()
    assert sum(r.raw_findings for r in rows) == found.count()
    assert sum(r.unique_findings for r in rows) == unique.count() == 2273
