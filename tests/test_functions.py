"""Normal forms, ids and decoding, against plain Python."""

import base64
import random

import plain
import pytest
from pyspark.sql import functions as F

from credsift.functions import text as T
from credsift.functions.codec import base64_text
from credsift.functions.entropy import shannon_entropy
from credsift.functions.keys import finding_id

VALUES = [
    "hello  world",
    "a\nb",
    "a\\nb",
    "X\\n  MII\nABC",
    "C:\\new",
    "\u00a0a\u2003b\x1cc\x0bd\x85e\u3000",
    "mail.pass=>\"q7\"",
    "(deep)Name_2=zz==",
    "$, ;'inner; value' ,$",
    "$a='b=c';",
    "'k' => 'v'",
    "PASSWORD=",
    "QUJDREVGRw==",
    "",
    "plain",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n INT, v STRING")
    rows = df.select("n", expr(F.col("v")).alias("out")).orderBy("n").collect()
    return [r.out for r in rows]


def test_normal_and_core_forms(spark):
    rng = random.Random(3)
    alphabet = "ab1_=>'\"$;, \n\\n.-()\t\u2009"
    values = VALUES + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)
    ]
    assert column(spark, values, T.normal_form) == [plain.norm(v) for v in values]
    assert column(spark, values, lambda v: T.core_form(T.normal_form(v))) == [
        plain.core(v) for v in values
    ]
    assert column(spark, values, T.strip_space) == [v.strip() for v in values]


def test_all_white_space_is_removed(spark):
    values = ["x" + chr(c) + "y" for c in range(1, 0x3100)]
    assert column(spark, values, T.without_space) == ["".join(v.split()) for v in values]


def test_ids(spark):
    got = column(spark, VALUES, lambda v: finding_id(F.lit("r"), F.lit("f"), v))
    assert got == [plain.finding_id("r", "f", v) for v in VALUES]


def lenient(value):
    if not value:
        return ""
    try:
        return base64.b64decode(value.encode()).decode("utf-8", errors="replace")
    except Exception:
        return value


def test_base64_is_as_lenient_as_the_usual_decoder(spark):
    rng = random.Random(4)
    values = ["", "QUJD", "QUI=", "QUI", "QUI=QUJD", "Q=U=I=", "=QUJD", "QUJD=", "QQ==", "Q", "!!"]
    values += [
        "".join(rng.choice("QUJDab01+/==-\n é") for _ in range(rng.randint(0, 12)))
        for _ in range(4000)
    ]
    values.append(base64.b64encode("ключ ".encode() * 3000).decode())
    assert column(spark, values, base64_text) == [lenient(v) for v in values]


def test_entropy(spark):
    got = column(spark, ["aaaa", "abab", "abcd"], shannon_entropy)
    assert got == pytest.approx([0.0, 1.0, 2.0])


def test_relative_paths(spark):
    def short(v):
        return T.relative_path(v, F.lit("/srv/work/app"), F.lit("work/app"))

    got = column(
        spark,
        ["/srv/work/app/a.py", "work/app//b.py", "/srv/work/app-2/c.py", "d.py"],
        short,
    )
    assert got == ["a.py", "b.py", "-2/c.py", "d.py"]


def test_tab_names(spark):
    got = column(spark, ["detect-secrets", "GITLEAKS", "x" * 40], T.tab_name)
    assert got == ["Detect-secrets", "Gitleaks", "X" + "x" * 30]


def test_white_space_is_told_by_a_short_way(spark):
    """Every sign of the two planes, as the plain class of signs takes it."""
    import re

    plain = re.compile("[\t-\r\x1c-\x20\x85\xa0  -     　]+")
    rows = [(f"{chr(c)}x{chr(c) * 2}",) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame(rows, "v string").select("v", T.without_space(F.col("v"))).collect()
    assert len(got) == len(rows) and all(out == plain.sub("", v) for v, out in got)
    # signs that most values are made of are told before the long class is tried
    assert T._SPACE.startswith("[[^!-~]&&[")
