"""Reports element by element: in windows, in chunks, and broken ones."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from credsift.sources import detect_secrets, gitleaks, json_parts, landing, registry, titus


def made_up(rng, tool):
    """A report with all sorts of texts, nested values and odd members."""

    def text():
        return "".join(rng.choice(['a', '"', "\\", "}", "{", "]", "é", "\n", ",", "x y"])
                       for _ in range(rng.randint(0, 12)))

    def extra():
        return rng.choice([None, 1.5, text(), [text(), {"a": text()}], {"k": {"l": [text()]}}])

    if tool == "gitleaks":
        odd = [5, None, text(), [{"Secret": "in a list"}], {"Secret": 7}, {}]
        return [
            rng.choice(odd) if rng.random() < 0.2
            else {"File": text(), "Secret": text(), "X": extra(), "StartLine": rng.randint(0, 9)}
            for _ in range(rng.randint(0, 30))
        ]
    if tool == "detect-secrets":
        return {
            "plugins": [{"name": text()}], "generated": {"a": {"b": {"c": 1}}},
            "results": {
                text() + str(i): rng.choice([
                    [{"type": text(), "hashed_secret": text(), "line_number": 3, "X": extra()}
                     for _ in range(rng.randint(0, 9))],
                    None, 5, [1, {"hashed_secret": "h"}, "x", {"hashed_secret": "i"}]])
                for i in range(rng.randint(0, 8))
            },
            "after": extra(),
        }

    def match():
        return rng.choice([
            {"BlobID": text(), "Snippet": {"Matching": base64.b64encode(text().encode()).decode()},
             "Location": {"Source": {"Start": {"Line": rng.randint(0, 9)}}}, "X": extra()},
            {"Snippet": {"Matching": text()}, "RuleName": text()}, 5, None, {"Snippet": None}])

    return [
        rng.choice([
            {"RuleID": text(), "Matches": [match() for _ in range(rng.randint(1, 12))],
             "RuleName": rng.choice(["", None, text()]), "Groups": [text()]},
            {"Groups": [base64.b64encode(b"g").decode(), extra()], "Matches": rng.choice([None, []])},
            {"Matches": {"a": 1}, "Groups": [text()]}, 5, [{"Matches": [match()]}], {}])
        for _ in range(rng.randint(0, 12))
    ]


TOOLS = {"gitleaks": gitleaks, "detect-secrets": detect_secrets, "titus": titus}


def wanted(tool, report):
    """(key, pos, sub, value) of all elements by plain means."""
    if tool == "gitleaks":
        return [(None, i, None, r) for i, r in enumerate(report)]
    if tool == "detect-secrets":
        return [(f, i, None, h) for f, hits in report["results"].items() if isinstance(hits, list)
                for i, h in enumerate(hits)]
    out = []
    for i, r in enumerate(report):
        if isinstance(r, dict) and isinstance(r.get("Matches"), list) and r["Matches"]:
            out += [(None, i, j, m) for j, m in enumerate(r["Matches"])]
        elif isinstance(r, dict):
            names = ("RuleName", "RuleID", "Groups")
            out.append((None, i, None, {k: r[k] for k in names if k in r}))
        else:
            out.append((None, i, None, r))
    return out


def shape_of(tool):
    places = TOOLS[tool]._places
    if tool == "titus":
        return json_parts.Shape(4, places, 2, titus._record)
    return json_parts.Shape({"gitleaks": 2, "detect-secrets": 4}[tool], places)


def useful(value):
    if isinstance(value, dict) and "Groups" in value:
        return {**value, "Groups": value["Groups"][:1]}
    return [] if isinstance(value, list) else value


@pytest.mark.parametrize("tool", TOOLS)
def test_elements_in_windows_of_any_size(tool):
    rng = random.Random(tool)
    for n in range(150):
        report = made_up(rng, tool)
        data = json.dumps(report, indent=rng.choice([None, 1]), ensure_ascii=n % 2 == 0).encode()
        for size in (1, 7, 60, 10_000):
            shape = shape_of(tool)
            rows = list(json_parts.elements(data, shape.level, shape.places, "m", 0, size))
            got = [(k, p, s, json.loads(t)) for _, k, p, s, t, *_ in rows]
            plain = [(k, p, s, v) for k, p, s, v in wanted(tool, report)]
            if tool == "titus":  # only a record's first group and its names are of use
                got, plain = ([(k, p, s, useful(v)) for k, p, s, v in r] for r in (got, plain))
            assert got == plain


def chunk_rows(data, rng):
    """Landing rows as the reader cuts them: behind ``}``, one ``}`` too many at an open end."""
    pieces = data.split(b"}")
    if pieces[-1] == b"":
        pieces.pop()
    rows, at, held = [], 0, b""
    for i, piece in enumerate(pieces):
        held += piece + b"}"
        if rng.random() < 0.3 or i + 1 == len(pieces):
            rows.append((at, 1, held.decode()))
            at, held = at + len(held), b""
    return [*rows, (len(data), 1, "")]


def found_and_bad(spark, rows, tools=TOOLS):
    raw = spark.createDataFrame(rows, landing.LANDING_DDL)
    found, bad = registry.read_reports(raw, list(tools))
    bad = bad.collect()
    columns = [F.col(c) for c in found.columns if c != "seq"]
    flat = found.select("seq.path", "seq.key", "seq.pos", "seq.sub", *columns).collect()
    return (
        sorted(tuple(map(str, r)) for r in flat),
        sorted((r.path, r.raw, r.reason) for r in bad if r.reason == "unusable record"),
        {r.path for r in bad if r.reason != "unusable record"},
    )


def test_reports_in_chunks_give_the_same(spark):
    rng = random.Random(5)
    whole, chunks = [], []
    for tool in TOOLS:
        for n in range(12):
            report = made_up(rng, tool)
            data = json.dumps(report, indent=rng.choice([None, 2]), ensure_ascii=False).encode()
            data += rng.choice([b"", b"\n", b"  "])
            if n % 4 == 3:  # broken in some way
                cut = rng.randrange(len(data))
                data = rng.choice([data[:-1].rstrip(), data[:cut] + b"?" + data[cut:], data + b"}",
                                   data[: len(data) // 2]])
            path = f"/d/{tool}-{n}"
            whole.append(("r", tool, path, 0, 0, data.decode("utf-8", "replace")))
            data = whole[-1][-1].encode()
            if data:
                chunks += [("r", tool, path, *c) for c in chunk_rows(data, rng)]
            else:
                chunks.append(whole[-1])
    rng.shuffle(chunks)
    one, many = found_and_bad(spark, whole), found_and_bad(spark, chunks)
    assert one == many
    assert one[0] and one[1] and one[2]


def test_a_report_that_lacks_a_chunk_is_broken(spark):
    data = json.dumps([{"Secret": f"s{n}", "File": "f"} for n in range(40)]).encode()
    rows = [("r", "gitleaks", "/d", *c) for c in chunk_rows(data, random.Random(1))]
    assert len(found_and_bad(spark, rows, ["gitleaks"])[0]) == 40
    assert found_and_bad(spark, rows[:1] + rows[2:], ["gitleaks"]) == ([], [], {"/d"})


def test_faults_name_their_byte(spark):
    good = json.dumps([{"Secret": "ä" * 9}] * 30, ensure_ascii=False)
    at = good.index('"Secret"', 300)
    rows = [
        ("r", "gitleaks", "/inside", 0, 0, good[:at] + "?" + good[at:]),
        ("r", "gitleaks", "/between", 0, 0, good.replace("}, {", "} {", 1)),
        ("r", "gitleaks", "/object", 0, 0, '{"a": 1}'),
        ("r", "gitleaks", "/deep", 0, 0, "[" * 100_000),
    ]
    _, bad = registry.read_reports(spark.createDataFrame(rows, landing.LANDING_DDL), ["gitleaks"])
    got = {r.path: (r.reason, r.at) for r in bad.collect()}
    assert got["/inside"] == ("broken json", len(good[:at].encode()))
    reason, near = got["/between"]
    assert reason == "broken json" and near == len((good[: good.index("}") + 2]).encode())
    assert got["/object"][0] == "not an array" and got["/deep"][0] == "broken json"


def test_large_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Every way of splitting a report gives the same rows, in the same order."""
    monkeypatch.setattr(landing, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(landing, "CHUNK_BYTES", 700)
    rng = random.Random(9)
    for tool in TOOLS:
        report = [made_up(rng, tool) for _ in range(16)]
        if tool == "detect-secrets":
            merged = {"results": {f"{i}{k}": v for i, r in enumerate(report)
                                  for k, v in r["results"].items()}}
        else:
            merged = [x for r in report for x in r]
        folder = tmp_path / "app"
        folder.mkdir(exist_ok=True)
        (folder / f"app_{landing.RAW_NAMES[tool]}").write_text(
            json.dumps(merged, ensure_ascii=False) + " " * 20_000, encoding="utf-8")
        # the last splits of the large report hold blanks only
        small = tmp_path / "small"
        small.mkdir(exist_ok=True)
        (small / f"small_{landing.RAW_NAMES[tool]}").write_text(json.dumps(report[0]))

    def read():
        found, bad = registry.read_reports(landing.read_landing(spark, str(tmp_path)), list(TOOLS))
        rows = [tuple(map(str, r)) for r in found.orderBy("seq", "id").collect()]
        return rows, sorted(map(str, bad.collect()))

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for split in ("1000000", "6007"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            results.append(read())
        monkeypatch.setattr(landing, "WHOLE_BYTES", 1 << 30)
        results.append(read())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [r[0] for r in results]
    assert len(rows[0]) > 200 and all(r == rows[-1] for r in rows)
    assert len({len(r[1]) for r in results}) == 1


def test_time_follows_the_length():
    """Texts that invite a scanner to start over and over."""
    for data in (b" " * 3_000_000, b'[{"a": 1' + b" 2" * 1_500_000, b'"' * 1_000_001,
                 b"\\" * 2_000_000, b'["' + b'\\"' * 1_000_000, b"[" * 1_000_000 + b"x" * 10**6):
        json_parts.walk(data, json_parts.State(), 2)
        json_parts.walk(data, json_parts.State(True), 2)


def test_arrays_tell_the_same_as_a_walk(monkeypatch):
    rng = random.Random(4)
    for n in range(20_000):
        monkeypatch.setattr(json_parts, "NEAR", rng.choice([1, 5, 1000]))
        signs = b'{}[]{}"\\a,' if n % 2 else b'{}[]{}"a,'
        data = bytes(rng.choice(signs) for _ in range(rng.randint(0, 24)))
        behind = [json_parts.walk(data, json_parts.State(inside))[1] for inside in (False, True)]
        assert json_parts.states_behind(data) == behind, data
        start, level = json_parts.State(rng.random() < 0.3, rng.randint(0, 3)), rng.randint(1, 4)
        want = json_parts.walk(data, start, level)[0]
        assert json_parts.objects(data, start, level) == want, (data, start, level)


def test_an_element_meets_its_own_run_alone(spark):
    """Numbers between the records make as many runs; no element is tried with all of a chunk."""
    record = b'{"Secret": "s%d"}'
    data = b"[" + b",7,".join(record % n for n in range(300)) + b"]"
    chunks = [("r", "gitleaks", "/d", 0, 1, data.decode() + "}"), ("r", "gitleaks", "/d", len(data), 1, "")]
    reports = spark.createDataFrame(chunks, landing.LANDING_DDL)
    found = gitleaks.findings(reports)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "first#" in joins[0] and ">=" not in joins[0]
    places = {r.secret_value: r.seq.pos for r in found.collect()}
    assert places == {f"s{n}": 2 * n for n in range(300)}
