"""Chat formatting: reversible templates, prefix trees against plain ones, digests."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credsift.llm import chat

PIECES = ["<", "[", "|", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "end|>\n",
          "ok", "\n", "é🙂", "<|", "</s>", "[INST]"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join),
       st.lists(st.sampled_from(["user", "|", "\\", "p", "\n", "<", ">", "assistant"]), max_size=5).map("".join))
@settings(max_examples=400, deadline=None)
def test_template_is_reversible(text, role):
    guarded = chat.escape(text)
    assert chat.unescape(guarded) == text
    for control in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in guarded
    formatted = chat.format_turn(role, text) + chat.format_turn("x", "y")
    assert chat.parse_turns(formatted) == [(role, text), ("x", "y")]


def plain_digest(conv_id, turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    return (conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), len(formatted))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(2)
    rows, known = [], {}
    for conv in [*range(60), None]:
        turns = [("user", "hello")] if rng.random() < 0.7 else [("system", "")]
        while rng.random() < 0.8 and len(turns) < 7:
            turns.append((rng.choice(["user", "assistant"]), rng.choice(["a", "b", "</s>", None])))
        known[conv] = turns
        rows += [(conv, i, r, t, 1) for i, (r, t) in enumerate(turns)]
    for conv in (61, 62, 63):  # equal conversations, and one with a NULL turn and role
        known[conv] = known[0]
        rows += [(conv, i, r, t, 1) for i, (r, t) in enumerate(known[0])]
    known[64] = [(None, "é" * 9000), ("assistant", "x " * 40_000)]
    rows += [(64, None, None, "é" * 9000, 1), (64, 1, "assistant", "x " * 40_000, 1)]
    rng.shuffle(rows)
    return rows, known


def test_digests_and_layout(spark, conversations):
    rows, known = conversations
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    trees = chat.pack(df)
    got = {r.conv_id: tuple(r) for r in chat.read_digests(trees).collect()}
    assert got == {c: plain_digest(c, t) for c, t in known.items()}

    nodes = trees.nodes.collect()
    paths = {r.conv_id: r for r in trees.paths.collect()}
    prefixes = {tuple((r or "", t or "") for r, t in turns[: i + 1])
                for turns in known.values() for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # shared turns once
    size = {(n.conv_id, n.depth): len(n.ids) // 4 for n in nodes}
    by_start = sorted(nodes, key=lambda n: n.start)
    ends = np.cumsum([size[n.conv_id, n.depth] for n in by_start])
    assert [n.start for n in by_start] == [0, *ends[:-1].tolist()]

    # depth first: each node right after its parent or after a whole subtree of a sibling
    where = {(n.conv_id, n.depth): n for n in nodes}
    stack = []
    for n in by_start:
        path = paths[n.conv_id].runs
        chain = [where[r.owner, d] for r in path for d in range(r.depth, r.depth + r.turns)]
        chain = [x.start for x in chain[: n.depth]]
        stack = stack[: n.depth]
        assert stack == chain
        stack.append(n.start)
        assert n.position == sum(size[r.owner, d] for r in path
                                 for d in range(r.depth, r.depth + r.turns) if d < n.depth)
    for path in paths.values():  # intervals cover the conversation's tokens in order
        spans = [list(range(where[r.owner, d].start, where[r.owner, d].start + size[r.owner, d]))
                 for r in path.runs for d in range(r.depth, r.depth + r.turns)]
        assert sum(spans, []) == sum((list(range(r.begin, r.end)) for r in path.runs), [])


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_digests(chat.pack(df)).count() == 0
    only = chat.formatting_digest(spark, df.withColumn("extra", F.lit(1))).collect()
    text = "</s>[INST] ok [/INST]"
    assert [tuple(r) for r in only] == [plain_digest(-1, [("user", text), ("assistant", text)])]
