"""Pass 3: the ordered fold and the linked folds against a plain walk over all values."""

import random

import plain
import pytest

from credsift.operators import overlaps
from credsift.operators.proximity import absorb_overlapping
from credsift.schema import FINDING_DDL
from credsift.session import cut


def _random_values(rng):
    shape = rng.randrange(5)
    alphabet = "ab" if shape < 3 else "abcd"
    values = []
    for _ in range(rng.randint(1, 9)):
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
        values.append(
            rng.choice(["", "", "k=", "ab=", "'", "a=>", "long_name="])
            + body
            + rng.choice(["", "", "=", "'", ";", "=b"])
        )
    if shape == 4:
        values.append("some_longer_name=" + rng.choice(["", "a", "="]))
    return list(dict.fromkeys(v for v in values))


def _rows(seed, groups):
    rng = random.Random(seed)
    rows, seq = [], 0
    for g in range(groups):
        seen = set()
        for value in _random_values(rng):
            if plain.norm(value) in seen:
                continue
            seen.add(plain.norm(value))
            seq += 1
            rows.append(
                {
                    "id": f"{g}-{seq}",
                    "repository": "r",
                    "file_path": f"f{g}",
                    "line_number": 1,
                    "secret_type": f"t{seq}",
                    "secret_value": value,
                    "commit_hash": "c",
                    "found_by": [rng.choice("wxyz")],
                    "seq": seq,
                }
            )
    return rows


def _expected(rows):
    out = []
    for group in plain.grouped(rows, lambda r: r["file_path"]):
        out.extend(plain.absorb(group))
    return {r["id"]: r["found_by"] for r in out}


@pytest.mark.parametrize("fold_rows,groups", [(256, 3000), (0, 400), (4, 200)])
def test_random_locations(spark, fold_rows, groups):
    rows = _rows(7 + fold_rows, groups)
    df = cut(spark.createDataFrame(rows, FINDING_DDL + ", seq BIGINT"), "t").repartition(5)
    got = absorb_overlapping(df, fold_rows=fold_rows).collect()
    assert {r["id"]: r["found_by"] for r in got} == _expected(rows)
    by_id = {r["id"]: r for r in rows}
    for r in got:
        assert r["secret_value"] == by_id[r["id"]]["secret_value"]
        assert r["secret_type"] == by_id[r["id"]]["secret_type"]


def _finding(n, value, path="min.js"):
    return {
        "id": f"i{n}",
        "repository": "r",
        "file_path": path,
        "line_number": 1,
        "secret_type": "t",
        "secret_value": value,
        "commit_hash": "c",
        "found_by": ["abcd"[n % 4]],
        "seq": n,
    }


def _absorbed(spark, rows, **settings):
    df = cut(spark.createDataFrame(rows, FINDING_DDL + ", seq BIGINT"), "t")
    got = absorb_overlapping(df, **settings).collect()
    return {r["id"]: r["found_by"] for r in got}


def test_crowded_line_with_hubs(spark):
    """Padded texts share tiny cores that lie in most values of the line."""
    rows = []
    for n in range(150):
        token = f"{n:03d}TOKEN{n * 7919 % 1009:04d}X"
        for value in (token, f'"key" = "AK{token}";', f"KEY={token}_{n}", f"{token[:6]}=="):
            rows.append(_finding(len(rows), value))
    assert _absorbed(spark, rows) == _expected(rows)


def test_a_long_chain_and_a_very_long_value(spark):
    chain = [_finding(n, f"P{n + 1}=P{n}", "chain") for n in range(1000)]
    words = [f"tok{n:05d}{n * 48271 % 65521:05d}" for n in range(20_000)]
    long = [_finding(2000, "x" * 5_000_000, "one"), _finding(2001, " ".join(words), "two")]
    inside = [_finding(3000 + n, f"{w}", "two") for n, w in enumerate(words[:300])]
    apart = [_finding(5000 + n, f"{n * 2654435761 % 2**32:08x}{n:06d}", "many") for n in range(5000)]
    got = _absorbed(spark, [*chain, *long, *inside, *apart])
    want = _expected(chain)
    want |= {"i2000": ["a"], "i2001": sorted({"abcd"[n % 4] for n in [2001, *range(3000, 3300)]})}
    want |= {r["id"]: r["found_by"] for r in apart}
    assert got == want


def test_the_fold_by_itself(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        rows = sorted(
            (_finding(n, v) for n, v in enumerate(dict.fromkeys(_random_values(rng)))),
            key=lambda r: -len(plain.norm(r["secret_value"])),
        )
        rows = list({plain.norm(r["secret_value"]): r for r in reversed(rows)}.values())[::-1]
        items = [
            (r["id"], plain.norm(r["secret_value"]), plain.core(r["secret_value"]), r["found_by"])
            for r in rows
        ]
        want = {r["id"]: r["found_by"] for r in plain.absorb(rows)}
        monkeypatch.setattr(overlaps, "_FEW", rng.choice([0, 64]))
        monkeypatch.setattr(overlaps, "_SHORT", rng.choice([3, 1024]))
        assert {i: sorted(t) for i, t in overlaps.fold(items)} == want


def test_many_values_with_tiny_cores_at_one_line(monkeypatch):
    """The index finds what comparing all survivors finds."""
    rng = random.Random(12)
    values = [f"{rng.randrange(2**60):015x}" for _ in range(1500)]
    values += [f"k={v[i : i + n]}" for v, i, n in
               ((rng.choice(values), rng.randrange(12), rng.randint(1, 9)) for _ in range(600))]
    items = sorted(
        ((str(n), plain.norm(v), plain.core(v), ["abcd"[n % 4]])
         for n, v in enumerate(dict.fromkeys(values))), key=lambda i: -len(i[1]))
    found = overlaps.fold(items)
    monkeypatch.setattr(overlaps, "_FEW", 10**9)
    assert found == overlaps.fold(items)


def test_a_stream_of_100_000_nested_values():
    """5 GB of text go through the fold; it holds one value."""
    items = ((str(n), "z" * (100_000 - n), "z" * (100_000 - n), ["abcd"[n % 4]])
             for n in range(100_000))
    assert overlaps.fold(items) == [("0", {"a", "b", "c", "d"})]


def test_repetitive_and_nested_values(spark):
    """Two values of 3 M equal characters, and values that lie in each other by the thousand."""
    million = 1_000_000
    same = [_finding(0, "A" * 3 * million, "same"), _finding(1, "A" * (3 * million - 1), "same"),
            _finding(2, "A" * million + "B" + "A" * million, "same")]
    text = "".join(f"{n * 2654435761 % 2**32:08x}" for n in range(250))
    nested = [
        _finding(10 + n, text[i : i + size], "nested")
        for n, (size, i) in enumerate((size, i) for size in range(2000, 1950, -1)
                                      for i in range(2000 - size + 1))
    ]
    deep = "ab" * 10_000
    nested += [_finding(10_000 + n, deep[: 20_000 - n], "deep") for n in range(0, 10_000, 10)]
    nested += [_finding(200_000 + n, f"S{text[: 1500 - n % 1400]}{n}", "many") for n in range(3000)]
    got = _absorbed(spark, [*same, *nested])
    assert got["i0"] == ["a", "b"] and "i1" not in got and got["i2"] == ["c"]
    assert got["i10"] == ["a", "b", "c", "d"]
    assert got["i10000"] == ["a", "c"]
    assert len([i for i in got if 10 <= int(i[1:]) < 10_000]) == 1
    assert len([i for i in got if 10_000 <= int(i[1:]) < 200_000]) == 1
