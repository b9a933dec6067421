"""Conversations as token sequences that share their common beginnings.

Template: ``<|role|>text<|end|>`` and a line feed per turn. Strings that a template could take for
control strings (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) get a
backslash after their first character; where there are backslashes already, one more. Taking one
away restores the text, so escaping is reversible for every text.

Prefix tree: a turn's node is named by a hash of all turns up to it, so conversations that begin
alike share nodes. A node belongs to the least conversation that has it. Along a conversation the
owners never decrease, so it is a few runs of nodes of one owner, the last of them its own; a
conversation equal to the beginning of another one owns nothing. The nodes of all trees form one
sequence, depth first, in which a node's first child is the one of its own owner: the nodes that a
conversation owns lie side by side, and an ancestor interval is a run. Every shared token is
emitted once. Position ids count the tokens of the conversation; the loss mask covers the texts of
assistants.

Nothing gathers a tree: owners are minima with map-side combining, the sequence is sorted by range
partitions, and conversations are read in order as streams.

Defined results: NULL roles and texts are empty ones; rows without a conv_id are one conversation;
turns are ordered by turn (NULL first), role and text, and repeated rows are repeated turns; an
empty table gives no conversations. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credsift.llm import bpe
from credsift.llm.common import running_totals
from credsift.session import cut

VOCABULARY = "byte_bpe_50k.json"
ASSISTANT = "assistant"
END = "<|end|>\n"
_NO_ID = -(1 << 63)

_CONTROL = re.compile(r"(?<=<)\\*(?=\||/?s>|</?SYS>>)|(?<=\[)\\*(?=/?INST\])")
_TURN = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>(.*?)<\|end\|>\n", re.S)


# --- template --------------------------------------------------------------------------------


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group()[1:], text)


def opening(role: str) -> str:
    return "<|" + role.replace("\\", "\\\\").replace("|", "\\p") + "|>"


def _role(spelled: str) -> str:
    return re.sub(r"\\(.)", lambda m: "|" if m.group(1) == "p" else m.group(1), spelled, flags=re.S)


def format_turn(role: str, text: str) -> str:
    return opening(role) + escape(text) + END


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        turns.append((_role(found.group(1)), unescape(found.group(2))))
        at = found.end()
    return turns


# --- tree ------------------------------------------------------------------------------------

_LINKED = "conv_id long, depth int, node string, ids binary, loss_begin int, loss_end int"


def _linked(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Every turn with its node and token ids; the conversations are read as streams."""
    content = bpe.read_vocabulary(turns.sparkSession, vocabulary)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(content.value)
        conv, depth, node = None, 0, b""
        for batch in batches:
            convs, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            pieces = []
            for role, text in zip(roles, texts, strict=True):
                pieces += [opening(role), escape(text), END]
            parts: list[np.ndarray] = []
            for ids, counts in encoder.encode(pieces):
                parts += np.split(ids, np.cumsum(counts)[:-1])
            rows = []
            for i, here in enumerate(convs):
                if here != conv:
                    conv, depth, node = here, 0, b""
                role, text = roles[i].encode(), texts[i].encode("utf-8", "surrogatepass")
                node = hashlib.sha256(b"%b%d:%b%b" % (node, len(role), role, text)).digest()[:16]
                head, body, tail = parts[3 * i : 3 * i + 3]
                begin = len(head)
                end = begin + (len(body) if roles[i] == ASSISTANT else 0)
                ids = np.concatenate([head, body, tail]).astype("<u4").tobytes()
                rows.append((here, depth, node.hex(), ids, begin, end))
                depth += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "depth", "node", "ids", "loss_begin", "loss_end"],
            )

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return (
        turns.select(
            F.coalesce("conv_id", F.lit(_NO_ID)).alias("conv_id"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            "turn",
        )
        .repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
        .mapInArrow(link, _LINKED)
    )


@dataclass
class PackedTrees:
    """``nodes``: conv_id (the owner), depth, start (place of the first token in the sequence),
    position (its position id), ids (little-endian unsigned 32-bit), loss_begin, loss_end.

    ``paths``: conv_id, n_turns, n_tokens, runs = array of (owner, depth, turns, begin, end): the
    intervals of the sequence that make up the conversation, in order. A token attends to those
    before its own node's, and to its own up to itself.
    """

    nodes: DataFrame
    paths: DataFrame
    vocabulary: str


def pack(turns: DataFrame, vocabulary: str = VOCABULARY) -> PackedTrees:
    """Merge conversations (conv_id, turn, role, text) into trees and lay them out."""
    linked = cut(_linked(turns, vocabulary), "chat-linked")
    owners = cut(linked.groupBy("node").agg(F.min("conv_id").alias("owner")), "chat-owners")
    size = (F.octet_length("ids") / 4).cast("long")
    owned = cut(
        linked.join(owners, "node").select(
            "conv_id",
            "depth",
            "owner",
            size.alias("n"),
            F.when(F.col("owner") == F.col("conv_id"), F.col("ids")).alias("ids"),
            "loss_begin",
            "loss_end",
        ),
        "chat-owned",
    )
    run = F.struct("depth", "owner", "turns", "n")
    runs = (
        owned.groupBy("conv_id", "owner")
        .agg(F.min("depth").alias("depth"), F.count("*").alias("turns"), F.sum("n").alias("n"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(run)).alias("runs"))
    )
    last = F.element_at("runs", -1)
    runs = cut(runs.withColumn("owns", last["owner"] == F.col("conv_id")), "chat-runs")

    # Depth first: a run that a path follows further comes first; a path's own end before that.
    step = F.transform(
        "runs",
        lambda r: F.when(
            r["owner"] == F.col("conv_id"),
            F.struct(r["owner"].alias("owner"), F.lit(0).alias("on"), F.lit(0).cast("long").alias("n")),
        ).otherwise(
            F.struct(r["owner"].alias("owner"), F.lit(1).alias("on"), (-r["turns"]).alias("n"))
        ),
    )
    segments = runs.filter("owns").select(
        F.col("conv_id").alias("segment"), step.alias("key"), last["n"].alias("n")
    )
    placed = cut(
        running_totals(segments, ["key"], ["n"], "chat-order").select(
            "segment", F.col("_before_n").cast("long").alias("first")
        ),
        "chat-segments",
    )
    spread = runs.select("conv_id", F.explode("runs").alias("r"))
    found = spread.join(placed, F.col("r.owner") == F.col("segment")).select(
        "conv_id",
        F.struct(
            F.col("r.depth").alias("depth"),
            F.col("r.owner").alias("owner"),
            F.col("r.turns").alias("turns"),
            F.col("first").alias("begin"),
            (F.col("first") + F.col("r.n")).alias("end"),
        ).alias("run"),
    )
    paths = found.groupBy("conv_id").agg(
        F.sum("run.turns").alias("n_turns"),
        F.sum(F.col("run.end") - F.col("run.begin")).alias("n_tokens"),
        F.array_sort(F.collect_list("run")).alias("runs"),
    )
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = owned.withColumn("position", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = runs.filter("owns").select(
        F.col("conv_id").alias("segment"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("whole"),
        last["n"].alias("own"),
    )
    nodes = (
        inside.filter(F.col("owner") == F.col("conv_id"))
        .join(base.join(placed, "segment"), F.col("conv_id") == F.col("segment"))
        .select(
            "conv_id",
            "depth",
            (F.col("first") + F.col("position") - (F.col("whole") - F.col("own"))).alias("start"),
            "position",
            "ids",
            "loss_begin",
            "loss_end",
        )
    )
    return PackedTrees(cut(nodes, "chat-nodes"), cut(paths, "chat-paths"), vocabulary)


# --- reading back ----------------------------------------------------------------------------

_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def conversation_nodes(trees: PackedTrees) -> DataFrame:
    """(conv_id, depth, ids, loss_begin, loss_end): the nodes of every conversation."""
    steps = trees.paths.select("conv_id", F.explode("runs").alias("r")).select(
        "conv_id",
        F.col("r.owner").alias("owner"),
        F.explode(F.sequence(F.col("r.depth"), (F.col("r.depth") + F.col("r.turns") - 1).cast("int")))
        .alias("depth"),
    )
    nodes = trees.nodes.select(
        F.col("conv_id").alias("owner"), "depth", "ids", "loss_begin", "loss_end"
    )
    return steps.join(nodes, ["owner", "depth"])


class _Reader:
    """Digests of one conversation, fed node by node."""

    def __init__(self, conv_id: int):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, loss: str) -> None:
        for role, text in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)
        plain = unescape(loss)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def read_digests(trees: PackedTrees) -> DataFrame:
    """What the packed trees hold of every conversation, decoded from the token ids."""
    content = bpe.read_vocabulary(trees.nodes.sparkSession, trees.vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reader = bpe.worker_vocabulary(content.value), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True))
            names = [part.split()[0] for part in _DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for batch in batches:
            rows = []
            for conv, octets, begin, end in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(conv)
                ids = np.frombuffer(octets, dtype="<u4").astype(np.int64)
                text = known.decode(ids).tobytes().decode("utf-8", "surrogatepass")
                loss = known.decode(ids[begin:end]).tobytes().decode("utf-8", "surrogatepass")
                reader.feed(text, loss)
            if rows:
                yield out(rows)
        if reader is not None:
            yield out([reader.row()])

    read = (
        conversation_nodes(trees)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "depth")
        .select("conv_id", "ids", "loss_begin", "loss_end")
        .mapInArrow(digest, _DIGEST)
    )
    return read.withColumn("conv_id", F.nullif("conv_id", F.lit(_NO_ID)))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations, and conversation -1, whose texts look like control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, ASSISTANT, text)],
        "conv_id long, turn long, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def formatting_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return read_digests(pack(with_probe(spark, conversations)))
