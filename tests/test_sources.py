"""Reading report files from a drop area."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from credsift.schema import FINDING_COLUMNS
from credsift.sources import blobs, detect_secrets, landing, registry, titus


def b64(text):
    return base64.b64encode(text.encode()).decode()


@pytest.fixture
def drop(tmp_path):
    def write(repository, tool, content):
        folder = tmp_path / repository
        folder.mkdir(exist_ok=True)
        name = f"{repository}_{landing.RAW_NAMES[tool]}"
        text = content if isinstance(content, str) else json.dumps(content)
        (folder / name).write_text(text, encoding="utf-8")
        return str(tmp_path)

    write.root = str(tmp_path)
    return write


def read(spark, root, tool):
    found = registry.read_findings(landing.read_landing(spark, root, [tool]), [tool])
    return [r.asDict() for r in found.orderBy("seq").collect()]


def test_gitleaks(spark, drop):
    drop(
        "my app",
        "gitleaks",
        [
            {"Description": "d", "StartLine": 12, "File": "c.yaml", "Commit": "abc",
             "Secret": "S1", "RuleID": "aws"},
            {"File": "b.py", "Secret": ""},
            {"StartLine": 0, "Secret": "S2", "RuleID": None},
        ],
    )
    got = read(spark, drop.root, "gitleaks")
    assert [r["secret_value"] for r in got] == ["S1", "", "S2"]
    assert [r["line_number"] for r in got] == [12, None, None]
    assert [r["secret_type"] for r in got] == ["aws", "Unknown", None]
    assert got[0]["repository"] == "my app"
    assert got[0]["found_by"] == ["gitleaks"]
    assert len({r["id"] for r in got}) == 3


@pytest.mark.parametrize("content", ["{corrupt", "[]", '{"File": "x"}', "", "null", "7"])
@pytest.mark.parametrize("tool", ["gitleaks", "titus"])
def test_unusable_array_reports_give_no_rows(spark, drop, tool, content):
    drop("r", tool, content)
    assert read(spark, drop.root, tool) == []


def test_one_bad_record_does_not_hide_the_others(spark, drop):
    drop("r", "gitleaks", [5, {"Secret": None}, {"Secret": "ok", "File": "f"}])
    assert [r["secret_value"] for r in read(spark, drop.root, "gitleaks")] == ["ok"]
    bad = registry.read_rejects(landing.read_landing(spark, drop.root)).collect()
    assert sorted(r.raw for r in bad) == ["5", '{"Secret":null}']


def test_trufflehog(spark, drop):
    git = {"Data": {"Git": {"file": "s.py", "commit": "x1", "line": 5}}}
    lines = [
        json.dumps({"SourceMetadata": git, "Raw": "one", "DetectorName": "D"}),
        '{"bad json',
        "",
        "   ",
        json.dumps([{"Raw": "in a list"}]),
        json.dumps({"SourceMetadata": git, "Raw": "", "Redacted": "r"}),
        json.dumps({"SourceMetadata": git, "Raw": None, "Redacted": "r"}),
        json.dumps({"SourceMetadata": git, "Redacted": "red"}),
        json.dumps({"SourceMetadata": {"Data": None}, "Raw": "lost"}),
        json.dumps({"SourceMetadata": None, "Raw": "lost"}),
        json.dumps({"Raw": "bare"}),
        json.dumps({"SourceMetadata": git, "Raw": 5}),
    ]
    drop("r", "trufflehog", "\n".join(lines) + "\n")
    got = read(spark, drop.root, "trufflehog")
    assert [r["secret_value"] for r in got] == ["one", "red", "bare"]
    assert [(r["file_path"], r["commit_hash"], r["line_number"]) for r in got] == [
        ("s.py", "x1", 5), ("s.py", "x1", 5), ("", "", None)]
    assert got[2]["secret_type"] == "Unknown"


def test_trufflehog_order_holds_across_splits(spark, drop):
    lines = [json.dumps({"Raw": f"secret-{n:05d}"}) for n in range(5000)]
    drop("r", "trufflehog", "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read(spark, drop.root, "trufflehog")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["secret_value"] for r in got] == [f"secret-{n:05d}" for n in range(5000)]


def test_detect_secrets(spark, drop):
    report = {
        "results": {
            "a.py": [{"type": "T1", "hashed_secret": "h1", "line_number": 1}],
            "b.py": [
                {"type": "T2", "hashed_secret": "h2", "line_number": 2},
                {"type": "T3", "hashed_secret": "h3", "line_number": 3},
            ],
        }
    }
    drop("r", "detect-secrets", report)
    raw = landing.read_landing(spark, drop.root)
    lines = spark.createDataFrame(
        [("r", "b.py", 2, "  password = 'x' "), ("other", "a.py", 1, "no")],
        "repository STRING, file_path STRING, line_number INT, line STRING",
    )
    assert [r.secret_value for r in detect_secrets.findings(raw).orderBy("seq").collect()] == [
        "h1", "h2", "h3"]
    looked_up = detect_secrets.findings(raw, lines).orderBy("seq").collect()
    assert [r.secret_value for r in looked_up] == ["h1", "password = 'x'", "h3"]


@pytest.mark.parametrize("content", ['{"results": {}}', "{bad", "[1]", '{"results": null}'])
def test_detect_secrets_without_results(spark, drop, content):
    drop("r", "detect-secrets", content)
    assert read(spark, drop.root, "detect-secrets") == []


def test_titus(spark, drop):
    def match(text, **more):
        return {"BlobID": "b1", "Snippet": {"Matching": b64(text)}, **more}

    drop(
        "r",
        "titus",
        [
            {
                "RuleID": "np.1",
                "RuleName": "",
                "Groups": [b64("unused")],
                "Matches": [
                    match("pin: 0417", Location={"Source": {"Start": {"Line": 5}}}),
                    match("  padded \n", RuleName="Named"),
                    match("   "),
                    {"Snippet": {"Matching": "not base64!"}},
                    {"Snippet": None},
                ],
            },
            {"RuleName": "Door code", "Groups": [b64("grp-0"), b64("x")], "Matches": []},
            {"Groups": [b64("lone")], "Matches": None},
            {"Groups": [], "Matches": []},
            {"RuleID": "np.2"},
        ],
    )
    raw = landing.read_landing(spark, drop.root, ["titus"])
    paths = spark.createDataFrame(
        [("r", "b1", "src/a.py"), ("q", "b1", "no")], "repository STRING, blob_id STRING, path STRING"
    )
    got = titus.findings(raw, paths).orderBy("seq").collect()
    assert [r.secret_value for r in got] == [
        "pin: 0417", "padded", "not base64!", "grp-0", "lone"]
    assert [r.secret_type for r in got] == ["np.1", "Named", "np.1", "Door code", "Unknown"]
    assert [r.file_path for r in got] == ["src/a.py", "src/a.py", "", "", ""]
    assert [r.line_number for r in got] == [5, None, None, None, None]


def test_missing_area_and_unknown_tool(spark, tmp_path):
    raw = landing.read_landing(spark, str(tmp_path / "nowhere"), ["gitleaks", "no-such-tool"])
    found = registry.read_findings(raw)
    assert found.columns == [*FINDING_COLUMNS, "seq", "blob_id"]
    assert found.count() == 0


def test_landing_round_trip_and_tool_selection(spark, drop, tmp_path):
    drop("r", "gitleaks", "[1,\n 2]")
    drop("r", "titus", "[]")
    raw = landing.read_landing(spark, drop.root)
    landing.write_landing(raw, str(tmp_path / "out"))
    again = landing.open_landing(spark, str(tmp_path / "out"))
    assert {(r.tool, r.value) for r in again.collect()} == {
        ("gitleaks", "[1,\n 2]"), ("titus", "[]")}
    assert [r.tool for r in landing.select_tools(again, ["titus", "x"]).collect()] == ["titus"]


def test_registering_a_reader_checks_its_columns(spark, drop):
    registry.register("bad-tool", lambda raw: raw)
    try:
        with pytest.raises(ValueError, match="bad-tool"):
            registry.read_findings(landing.read_landing(spark, drop.root), ["bad-tool"])
    finally:
        registry._readers.pop("bad-tool")


def test_blob_paths_from_text_across_chunks(spark):
    text = ["Blob: b0", "\x1b[1mFile: a.py\x1b[0m", "noise", "  Blob: b1", "Blob: b2",
            "File:", "Blob: b3", "File: c.py", "Blob: b1", "Blob:"]
    lines = spark.createDataFrame(
        [("r", n, t) for n, t in enumerate(text)] + [("q", 0, "Blob: b1")],
        "repository STRING, line_no BIGINT, line STRING",
    )
    for chunk in (1, 2, 3, 1000):
        got = blobs.paths_from_text(lines, chunk).collect()
        assert {(r.repository, r.blob_id): r.path for r in got} == {
            ("r", "b1"): "c.py", ("r", "b2"): "a.py"}


def test_relative_blob_paths(spark):
    paths = spark.createDataFrame(
        [("r", "b", "/w/r/src/a.py"), ("s", "b", "x.py")],
        "repository STRING, blob_id STRING, path STRING",
    )
    roots = spark.createDataFrame(
        [("r", "/w/r", "r")], "repository STRING, absolute_root STRING, given_root STRING"
    )
    got = blobs.relative_paths(paths, roots).collect()
    assert {r.repository: r.path for r in got} == {"r": "src/a.py", "s": "x.py"}


def test_reports_above_the_size_of_one_variant(spark, drop):
    """Every hit of a report of 150 MB is read, whatever the tool and however it groups its hits."""
    filler, count = "x" * 2000, 75_000
    record = '{{"File": "f{0}", "Secret": "s{0}", "Note": "' + filler + '"}}'
    drop("big", "gitleaks", "[" + ",".join(record.format(n) for n in range(count)) + "]")
    hit = '{{"type": "t", "hashed_secret": "h{0}", "line_number": {0}, "note": "' + filler + '"}}'
    drop("big", "detect-secrets", '{"version": "1", "results": {"small": [' + hit.format(count)
         + '], "all": [' + ",".join(hit.format(n) for n in range(count)) + "]}}\n")
    match = '{{"BlobID": "b", "Snippet": {{"Matching": "{0}"}}, "Note": "' + filler + '"}}'
    drop("big", "titus", '[{"RuleID": "r1", "Matches": ['
         + ",".join(match.format(b64(f"t{n}")) for n in range(count))
         + '], "RuleName": "late"}, {"RuleName": "n", "Matches": [' + match.format(b64("last")) + "]}]")
    raw = landing.read_landing(spark, drop.root)
    found, bad = registry.read_reports(raw)
    per_tool = found.groupBy(F.col("found_by")[0].alias("t")).agg(
        F.countDistinct("secret_value").alias("n"), F.countDistinct("seq").alias("places")
    )
    want = {"gitleaks": count, "detect-secrets": count + 1, "titus": count + 1}
    assert {r.t: r.n for r in per_tool.collect()} == want
    assert {r.t: r.places for r in per_tool.collect()} == want
    names = found.filter("found_by[0] = 'titus'").groupBy("secret_type").count().collect()
    assert {r.secret_type: r["count"] for r in names} == {"late": count, "n": 1}
    assert bad.count() == 0
    # several tasks read one report
    assert raw.filter("tool = 'titus' AND pos > 0").select("block").distinct().count() > 2


def test_repositories_of_several_folders(spark, tmp_path):
    for org in ("one", "two"):
        folder = tmp_path / org / "repository=api"
        folder.mkdir(parents=True)
        (folder / "api_gitleaks_raw.json").write_text('[{"Secret": "k"}]')
    near = landing.read_landing(spark, str(tmp_path), ["gitleaks"])
    far = landing.read_landing(spark, str(tmp_path), ["gitleaks"], levels=2)
    assert {r.repository for r in near.collect()} == {"api"}
    assert {r.repository for r in far.collect()} == {"one/api", "two/api"}


def test_a_registered_tool_is_landed_and_read(spark, tmp_path):
    from credsift.functions.keys import finding_id
    from credsift.schema import TOOLS, arrival

    def reader(raw):
        parts = F.split("value", "\t")
        return raw.filter("tool = 'tabs'").select(
            finding_id(F.col("repository"), parts[0], parts[1]).alias("id"),
            "repository",
            parts[0].alias("file_path"),
            F.lit(None).cast("int").alias("line_number"),
            F.lit("tab").alias("secret_type"),
            parts[1].alias("secret_value"),
            F.lit("").alias("commit_hash"),
            F.array(F.lit("tabs")).alias("found_by"),
            arrival("tabs", F.col("path"), F.col("block"), F.lit(""), F.col("pos"), F.lit(0)).alias("seq"),
        )

    registry.register("tabs", reader, raw_name="tabs_raw.txt", by_line=True)
    try:
        (tmp_path / "shop").mkdir()
        (tmp_path / "shop" / "shop_tabs_raw.txt").write_text("a.py\tv1\nb.py\tv2\n")
        got = registry.read_findings(landing.read_landing(spark, str(tmp_path))).collect()
        assert {(r.repository, r.file_path, r.secret_value) for r in got} == {
            ("shop", "a.py", "v1"), ("shop", "b.py", "v2")}
        assert {r.seq.tool for r in got} == {TOOLS.index("tabs")}
    finally:
        registry._readers.pop("tabs")
        TOOLS.remove("tabs")
        landing.RAW_NAMES.pop("tabs")
        landing.LINE_DELIMITED.discard("tabs")


def test_landing_is_written_small(spark, tmp_path):
    """With a codec that finds the names that all reports repeat."""
    path = str(tmp_path / "out")
    rows = [("r", "gitleaks", "/p", 0, 0, "[]")]
    landing.write_landing(spark.createDataFrame(rows, landing.LANDING_DDL), path)
    names = [p.name for p in (tmp_path / "out").rglob("*.parquet")]
    assert names and all(".zstd." in name for name in names)


def test_repository_names_are_cut_at_slashes(spark):
    """A pattern is tried from every character of the path, for every line of a report."""
    paths = ["", "a", "/a", "r/f", "/x/r/f", "file:///d/repository=q/f", "//f", "x/repository=/f",
             "a/b/c/", None, "s3a://b/o1/r1/r1_titus_raw.json"]
    rows = spark.createDataFrame([(p,) for p in paths], "path STRING")
    for levels in (1, 2, 3):
        pattern = rf"((?:[^/]*/){{0,{levels - 1}}}[^/]*)/[^/]*$"
        old = F.regexp_replace(F.regexp_extract("path", pattern, 1), "(^|/)repository=", "$1")
        name = landing.repository_of(F.col("path"), levels)
        assert "regexp_extract" not in str(name).lower()
        for row in rows.select("path", old.alias("old"), name.alias("new")).collect():
            assert row.old == row.new, row
