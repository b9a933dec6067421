"""Scans for secrets that run over several lines."""

from credsift.operators import scan

KEY = "-----BEGIN {0}PRIVATE KEY-----\n{1}\n-----END {0}PRIVATE KEY-----"


def scanned(spark, *texts):
    rows = [("r", f"f{n}", "c", text) for n, text in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "repository STRING, file_path STRING, commit_hash STRING, text STRING"
    )
    found = scan.scan_all(df).filter("secret_type = 'private-key'").collect()
    return sorted((r.file_path, r.line_number, r.secret_value) for r in found)


def test_whole_keys(spark):
    one, two = KEY.format("RSA ", "b1\nb2"), KEY.format("", "b3")
    got = scanned(
        spark,
        f"x\n{one}\ny\n{two}",
        one.replace("\n", "\r\n"),
        "a -----BEGIN PRIVATE KEY----- without an end",
        "KEY='" + two + "'",
        None,
        "",
    )
    assert got == [
        ("f0", 2, one), ("f0", 7, two), ("f1", 1, one),
        ("f2", 1, "-----BEGIN PRIVATE KEY-----"), ("f3", 1, two),
    ]


def test_keys_in_one_line(spark):
    first, second = (KEY.format("", b).replace("\n", " ") for b in "ab")
    assert scanned(spark, f"{first} {second}") == sorted([("f0", 1, first), ("f0", 1, second)])


def test_keys_that_share_an_end_or_have_none(spark):
    head, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    text = f"{head}\na\n{head} b\n{end} {head}\nc\n{head}"
    assert scanned(spark, text) == [
        ("f0", 1, f"{head}\na\n{head} b\n{end}"),
        ("f0", 3, f"{head} b\n{end}"),
        ("f0", 4, head),
        ("f0", 6, head),
    ]


def test_many_keys_in_one_text(spark):
    """10,000 keys, and as many without an end, in time linear in the text."""
    import time

    def text(n):
        keys = "\n".join(KEY.format("", f"key {i}") for i in range(n))
        return keys + "\n-----BEGIN PRIVATE KEY-----" * n

    scanned(spark, text(10))
    times = []
    for n in (2500, 10_000):
        start = time.perf_counter()
        got = scanned(spark, text(n))
        times.append(time.perf_counter() - start)
        assert len(got) == 2 * n
        assert got[-1][2] == "-----BEGIN PRIVATE KEY-----" and len({v for *_, v in got}) == n + 1
    assert times[1] < 60, times
