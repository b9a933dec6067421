"""Small reports parsed once give what their texts give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from credsift.schema import FINDING_COLUMNS
from credsift.sources import detect_secrets, gitleaks, json_parts, titus
from test_json_parts import TOOLS, made_up

SHAPES = {
    "gitleaks": json_parts.Shape(2, gitleaks._places, plain=gitleaks._plain),
    "detect-secrets": json_parts.Shape(4, detect_secrets._places, plain=detect_secrets._plain),
    "titus": json_parts.Shape(4, titus._places, 2, titus._record, titus._plain),
}
TOOLS_SHAPES = {
    "gitleaks": json_parts.Shape(2, gitleaks._places, plain=gitleaks._plain, fields=gitleaks._fields),
    "detect-secrets": json_parts.Shape(
        4, detect_secrets._places, plain=detect_secrets._plain, fields=detect_secrets._fields
    ),
    "titus": json_parts.Shape(4, titus._places, 2, titus._record, titus._plain, titus._fields),
}
USUAL = {
    "gitleaks": '[{"Secret": "a", "StartLine": 3}, {"Secret": null}]',
    "detect-secrets": '{"results": {"f": [{"hashed_secret": "h"}, {"type": "t"}], "g": null}}',
    "titus": '[{"Matches": [{"Snippet": {"Matching": "QQ=="}}, {"Snippet": null}]}, {"Groups": []}]',
}


def landing_of(spark, tool, texts):
    rows = [("repo", tool, f"/{n}", 0, 0, text) for n, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "repository STRING, tool STRING, path STRING, block BIGINT, pos BIGINT, value STRING"
    ).repartition(4)


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_usual_reports_are_parsed_once(tool):
    found = json_parts.plain_elements(USUAL[tool].encode(), SHAPES[tool])
    assert [row[3] is None for row in found] == {"titus": [False, True, False]}.get(tool, [False, True])


@pytest.mark.parametrize("tool", sorted(TOOLS))
@pytest.mark.parametrize("text", ["{corrupt", "", "7", '[{"Secret": NaN}]', '["\\ud800"]', '[1] 2'])
def test_others_are_not(tool, text):
    assert json_parts.plain_elements(text.encode(), SHAPES[tool]) is None


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_same_findings_and_rejects_as_by_text(spark, tool):
    rng = random.Random(5)
    texts = [json.dumps(made_up(rng, tool)) for _ in range(60)]
    texts += [USUAL[tool], "{corrupt", "[]", "{}", '[{"Secret": 1e2}]', None, '[{"File": 1.50}]']
    texts += ['[{"RuleName": 7, "Matches": [{"RuleName": true}, {"BlobID": null}, {"BlobID": 4}]}]']
    texts += ['{"results": {"a": [{"hashed_secret": "x", "type": null, "line_number": "4"}, 1.0]}}']
    small = landing_of(spark, tool, texts)
    # too large to be parsed in one piece
    padded = small.withColumn(
        "value", F.concat("value", F.lit(" " * (json_parts.SMALL + 1)))
    )
    reader = TOOLS[tool]

    def rows(df, *columns):
        return sorted(map(repr, df.select(*columns).collect()))

    assert rows(reader.findings(small), *FINDING_COLUMNS, "seq") == rows(
        reader.findings(padded), *FINDING_COLUMNS, "seq"
    )
    raw = F.rtrim("raw").alias("raw")
    assert rows(reader.rejects(small), "path", raw, "reason", "at") == rows(
        reader.rejects(padded), "path", raw, "reason", "at"
    )
    both = reader.parts(small)
    assert rows(reader.findings_of(both), "id", "seq") == rows(reader.findings(small), "id", "seq")
    assert rows(reader.rejects_of(both), "path", "at") == rows(reader.rejects(small), "path", "at")


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_unusable_elements_of_usual_reports_need_no_skeleton(tool):
    """Their texts and bytes come from the places of the objects; a name given twice is looked at."""
    rows = {
        "gitleaks": (' [5, {"Secret": 7}, {"Secret": "a"}]', [("5", None), ('{"Secret": 7}', 5)]),
        "detect-secrets": (
            '{"results": {"f": [{"hashed_secret": "h"}, {"type":  "t"}], "g": [null]}}',
            [('{"type":  "t"}', 43), ("null", None)],
        ),
        "titus": (
            '[{"Matches": [{}, {"Snippet":  null}, 4]}, 5, {"Groups": []}]',
            [('{"Snippet":  null}', 18), ("4", None), ("5", None)],
        ),
    }
    text, bad = rows[tool]
    found = json_parts.plain_elements(text.encode(), TOOLS_SHAPES[tool])
    got = list(json_parts.unfit_elements(text.encode(), TOOLS_SHAPES[tool], found))
    assert [(row[4], row[7]) for row in got] == bad


def test_names_given_twice_are_looked_at():
    text = b'{"results": {"a": [], "b": [{"type": 1}], "a": [{"type":  2}]}}'
    shape = TOOLS_SHAPES["detect-secrets"]
    found = json_parts.plain_elements(text, shape)
    with pytest.raises(json_parts.Unusual):
        list(json_parts.unfit_elements(text, shape, found))


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_records_in_chunks_are_parsed_once(tool):
    record = {
        "gitleaks": '{"Secret": "a", "File": "f"}',
        "detect-secrets": '{"hashed_secret": "h"}',
        "titus": '{"Matches": [{"Snippet": {"Matching": "QQ=="}}, {"Snippet": null}]}',
    }[tool]
    shape = TOOLS_SHAPES[tool]
    depth = (shape.outer or shape.level) - 1
    row = {"at": 9, "inside": False, "depth": depth, "trim": False, "short": False, "no": 1,
           "octets": f",{record},{record}".encode()}
    plain = list(json_parts._pieces(row, shape, "m", True, False))[:-1]
    assert [p[0] for p in plain] == [0, 1] and all(p[2] is None and p[6] for p in plain)
    both = list(json_parts._pieces(row, shape, "m", True, True))[:-1]
    assert [p[6] is None for p in both] == {"titus": [True] * 4}.get(tool, [False] * 2)
