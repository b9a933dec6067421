"""Registered queries against their SQL twins, and the pipeline against plain statements."""

import base64
import hashlib
import os
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from credsift.llm import bpe, language, simhash, toxicity  # noqa: E402
from credsift.llm.common import table  # noqa: E402
from credsift.llm.queries import ORACLES, QUERIES  # noqa: E402
from credsift.session import cut  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_one_query_per_operator():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    verdict = check.compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES[name])
    assert verdict.endswith("ok"), verdict


def near_groups(rows):
    """The least doc_id of every doc_id's group, by comparing all pairs."""
    prints = {r.doc_id: simhash.text_fingerprint(r.text, 3) for r in rows}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def plain_mix(rows):
    """The copies of each document: targets by repeated resharing, then the seeded draw."""
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: s.encode()))}
    left, capped = 1.5 * sum(total.values()), {}
    while True:
        free = [s for s in total if s not in capped]
        level = left / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * total[s]
            left -= capped[s]
    target = {s: capped.get(s, level * weight[s]) for s in total}
    out = {}
    for r in rows:
        rate = target[r.source] / total[r.source] if total[r.source] else 0
        draw = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        out[r.doc_id] = int(rate) + (draw < rate - int(rate))
    return out


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], sf_dir), f"test-{name}"))
        if name != "encoding":
            assert tables[-1].columns == docs.columns
    rows = [t.collect() for t in tables]

    scores = toxicity.scored(docs, table(spark, sf_dir, "labels")).collect()
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in scores if r.score < 0.5}
    assert len(rows[1]) >= 0.8 * len(rows[0])

    found = language.document_languages(tables[1]).collect()
    assert {r.doc_id for r in rows[2]} == {r.doc_id for r in found if r.kept}
    assert len(rows[2]) >= 0.98 * len(rows[1])

    root = near_groups(rows[2])
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(root.values()))

    copies = plain_mix(rows[3])
    taken = [r.doc_id for r in rows[4]]
    assert {d: taken.count(d) for d in copies} == copies

    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    text = {r.doc_id: r.text for r in rows[4]}
    assert sorted(r.doc_id for r in rows[5]) == sorted(taken)
    assert all(r.ids == library.encode_ordinary(text[r.doc_id]) for r in rows[5])


def test_the_rest_does_without_this_part(tmp_path):
    """A copy without the operators' folders imports and has the other queries."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(
        root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    )
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    counts = done.stdout.split()
    assert counts[0] == counts[1] and int(counts[0]) >= 56


def test_pipeline_with_odd_tables(spark, tmp_path):
    """NULLs in every column, empty and long texts, repeated rows, clashing columns, no rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.limit(60).collect()]
    rows += [(None, None, None, None, None), (901, None, "en", "a", 0), (902, "", None, None, 0),
             (903, rows[0][1], None, "a", 1), (904, "the words of this text " * 30_000, "en", "a", 9),
             (None, rows[1][1], "en", None, 2), *rows[:3], *rows[:3]]
    odd = spark.createDataFrame(
        [(*r, 0.5, [1], "x") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, "
        "ids array<int>, _row string",
    )
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd_labels = labels.union(spark.createDataFrame(
        [(None, 1, 1), (901, None, None), (902, 1, 1)], labels.schema))

    def run(name, documents):
        folder = str(tmp_path / name)
        documents.write.parquet(f"{folder}/documents.parquet")
        odd_labels.write.parquet(f"{folder}/labels.parquet")
        return corpus_pipeline.run(spark, folder)

    got = run("odd", odd)
    assert set(got.columns) == {"doc_id", "source", "lang", "ids"}
    found = got.collect()
    assert found and {r.doc_id for r in found} <= {r[0] for r in rows}
    assert all(r.ids is not None for r in found)
    assert run("none", odd.limit(0)).collect() == []
