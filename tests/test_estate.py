"""Reports of many records, one per repository: how they are made, and how the stream reads them."""

import json
import os

from pyspark.sql import functions as F

from credsift.plans import inputs

KEYS = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT"


def _items(spark, folder, rows):
    spark.createDataFrame(rows, KEYS).write.parquet(os.path.join(folder, "lineitem.parquet"))
    return str(folder)


def test_lines_come_in_the_order_of_their_paths(spark, tmp_path):
    rows = [(o, n, p, 8 * s) for o in (3, 12, 7, 25) for n in (2, 1) for p in (5, 40) for s in (1, 2)]
    rows += [(3, None, 5, 8), (None, 4, 5, 8), (12, 1, None, 16), (None, None, 7, 8), (7, 1, 5, None)]
    sf_dir = _items(spark, tmp_path, rows)
    for tool, reports in (("gitleaks", inputs.gitleaks_reports), ("titus", inputs.titus_reports)):
        want = {}
        records = reports(spark, sf_dir).filter(F.startswith("value", F.lit("["))).filter("value <> '[]'")
        for r in sorted(records.collect(), key=lambda r: r.path or ""):
            want.setdefault(r.repository, ["[7"]).append("," + r.value[1:-1])
        got = {}
        for r in inputs.repository_report_lines(spark, sf_dir, tool).collect():
            got.setdefault(r.repository, []).append(r.value)
        assert got == {name: [*lines, "]"] for name, lines in want.items()}
        assert len(got["repo-0"]) > 15


def test_the_task_of_a_report_sorts_no_texts(spark, sf_dir):
    node = inputs.repository_report_lines(spark, sf_dir, "titus")._jdf.queryExecution().sparkPlan()
    while not node.nodeName().startswith("Sort"):
        assert node.nodeName() in ("Project", "CollectLimit"), node.nodeName()
        node = node.children().apply(0)
    columns = [node.output().apply(i).name() for i in range(node.output().size())]
    assert set(columns) == {"repository", "part", "ok", "ln", "pk", "sk"}


def test_the_stream_reads_large_reports_in_chunks(spark, tmp_path, monkeypatch):
    from credsift.sources import landing
    from credsift.streaming import ingest

    monkeypatch.setattr(landing, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(landing, "CHUNK_BYTES", 700)
    # signs of patterns in a name stand for themselves
    folder = tmp_path / "drop" / "a[1]{b},c*d e+é"
    folder.mkdir(parents=True)
    report = [{"File": f"f{n}.py", "Secret": f"s{n}", "StartLine": n} for n in range(1, 400)]
    (folder / "x_gitleaks_raw.json").write_text(json.dumps(report))
    (tmp_path / "drop" / "a1b").mkdir()
    (tmp_path / "drop" / "a1b" / "y_gitleaks_raw.json").write_text('[{"Secret": "small"}]')
    longest = []
    read = ingest.read_findings

    def reading(rows, tools):
        longest.append(rows.agg(F.max(F.length("value"))).head()[0])
        return read(rows, tools)

    monkeypatch.setattr(ingest, "read_findings", reading)
    ingest.stream_reports(
        spark, "gitleaks", str(tmp_path / "drop"), str(tmp_path / "state"), str(tmp_path / "ckpt")
    ).awaitTermination()
    found = ingest.current_by_id(spark, str(tmp_path / "state")).collect()
    assert {(r.repository, r.secret_value) for r in found} == {
        ("a1b", "small"), *(("a[1]{b},c*d e+é", f"s{n}") for n in range(1, 400))}
    assert max(longest) < 2000
