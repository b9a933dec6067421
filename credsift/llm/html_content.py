"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree (``page_tree``) is dropped, is content, or is neutral: a frame that holds
both, as the page itself. The model has two tables of counts:

* potentials between parent and child: how often a child of a kind (heading, paragraph, menu, advert,
  ...) has which state under a parent of which state;
* potentials of a node: how often a node of a state has the size, share of link text, and number of
  texts it shows; for a text also how it ends and what kind of element holds it.

Both come from labelled pages: pages whose author marks the one article by ``<article>``. What lies in it is content, but for what lies in a menu, sidebar, advert, form, comment
or the like; what holds it is neutral; the rest is dropped. Each labelled page teaches twice, as it
is and in disguise: without any telling tag or name, so that pages without such marks are judged by
their looks. Fixed pseudo-counts stand for the task itself: what the named kinds mean, that nothing
is content inside what is dropped, and that an article loses nothing but named kinds.

Messages are passed exactly, upward from the leaves and downward from the root (sum-product), for all
pages of a batch at once, one level of the trees after the other. A text with a marginal of a half or
more is content. Texts of content are joined in page order.

Training counts are grouped sums over a sample of ``SAMPLE`` pages, about; the whole model is a few
hundred numbers.

Defined results: a NULL or empty page, and one without content, gives an empty text of 0 characters.
Every row gives one row, repeated rows and rows without an id or address too. White space is what
Unicode says it is, after character references are decoded. Without any labelled page the
pseudo-counts alone decide. Broken markup never fails; what never ends reaches to the end. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.llm.common import hash_unit
from credsift.llm.page_tree import (
    ARTICLE,
    KIND,
    KINDS,
    MAIN,
    NAMED,
    OTHER,
    ROOT,
    TEXT,
    Forest,
    page_text,
)

# Pages that teach, about.
SAMPLE = 4000
SEED = "page-labels-1"

DROPPED, CONTENT, NEUTRAL = range(3)
# The share of a feature's table that says nothing, as features of one node depend on each other.
_DOUBT = 0.25
_DROPS = range(KIND["menu"], NAMED)

_SIZES = 24
_SHARES = 6
# Features of a node and the values each may have; elements and texts have values of their own.
FEATURES = {"size": 2 * _SIZES, "linked": 2 * _SHARES, "form": _SIZES + 2 * len(KINDS)}
_STOPS = tuple(".!?…。！？؟।:;\"'”’»)")


class Trees:
    """The trees of a batch with the features of their nodes."""

    def __init__(self, pages: list[str | None]):
        forest = Forest()
        for html in pages:
            forest.add(html)
        self.forest = forest
        self.parent = np.array(forest.parent, dtype=np.int64)
        self.kind = np.array(forest.kind, dtype=np.int64)
        level = np.array(forest.level, dtype=np.int64)
        order = np.argsort(level, kind="stable")
        ends = np.cumsum(np.bincount(level)) if len(level) else []
        # the nodes of each level from the root's children on
        self.levels = [order[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.text_node = np.array(forest.text_node, dtype=np.int64)

    def summed(self, of_texts: np.ndarray) -> np.ndarray:
        """A number of each text, summed over all nodes above it."""
        total = np.zeros(len(self.kind))
        total[self.text_node] = of_texts
        for nodes in reversed(self.levels):
            np.add.at(total, self.parent[nodes], total[nodes])
        return total

    def features(self, kind: np.ndarray) -> np.ndarray:
        """(feature, node) values; ``kind`` may be disguised."""
        texts = [" ".join(t.split()) for t in self.forest.text]
        size = np.array([len(t) for t in texts], dtype=float)
        stops = np.array([t.endswith(_STOPS) for t in texts], dtype=np.int64)
        linked = np.array(self.forest.linked, dtype=float)
        chars, link_chars = self.summed(size), self.summed(size * linked)
        many = self.summed((size > 0).astype(float))
        is_text = kind == TEXT
        share = np.divide(link_chars, chars, out=np.zeros_like(chars), where=chars > 0)
        shares = np.where(chars > 0, 1 + np.floor(share * (_SHARES - 2)), 0).astype(np.int64)
        ends = np.zeros(len(kind), dtype=np.int64)
        ends[self.text_node] = stops
        plain = np.where(kind < NAMED, OTHER, kind)
        held = _SIZES + 2 * plain[np.maximum(self.parent, 0)] + ends
        return np.stack(
            [
                _log(chars) + _SIZES * is_text,
                shares + _SHARES * is_text,
                np.where(is_text, held, _log(many)),
            ]
        )

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """(states, taught): the states that the one marked article of a page gives, and the nodes
        of pages that have exactly one."""
        n, pages = len(self.kind), len(self.forest.roots)
        state = np.zeros(n, dtype=np.int64)
        outer = np.zeros(n, dtype=bool)  # marked articles that lie in none other
        within = np.zeros(n, dtype=bool)
        page = np.zeros(n, dtype=np.int64)
        page[self.forest.roots] = np.arange(pages)
        for nodes in self.levels:
            up, kind = self.parent[nodes], self.kind[nodes]
            page[nodes] = page[up]
            drops = (kind < NAMED) & (kind != MAIN) & (kind != KIND["header"])
            state[nodes] = np.where(
                kind == ARTICLE, CONTENT, np.where(drops, DROPPED, state[up])
            )
            outer[nodes] = (kind == ARTICLE) & ~within[up]
            within[nodes] = within[up] | (kind == ARTICLE)
        marks = np.bincount(page, weights=outer, minlength=pages)
        holds = self._above(outer)
        state[holds & ~within] = NEUTRAL
        return state, marks[page] == 1

    def _above(self, marked: np.ndarray) -> np.ndarray:
        holds = marked.copy()
        for nodes in reversed(self.levels):
            np.logical_or.at(holds, self.parent[nodes], holds[nodes])
        return holds


def _log(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(x + 1)), _SIZES - 1).astype(np.int64)


def _prior_edges() -> np.ndarray:
    """(kind, parent's state, own state) pseudo-counts; 0 for what cannot be, however it looks."""
    prior = np.ones((len(KINDS), 3, 3))
    prior[:, DROPPED] = (1, 0, 0)
    prior[:, CONTENT] = (0, 1, 0)
    prior[TEXT, NEUTRAL] = (1, 1, 0)
    prior[ARTICLE, NEUTRAL] = (0, 1, 0)
    prior[MAIN, NEUTRAL] = (0.05, 1, 0.3)
    for kind in _DROPS:
        prior[kind] = (1, 0, 0)
    # some sites put all of a page into one form; an article's own header is told by its looks
    prior[KIND["form"], NEUTRAL] = (0.95, 0, 0.05)
    prior[KIND["header"], CONTENT] = (1, 1, 0)
    return prior


class Model:
    """Logarithms of the potentials."""

    def __init__(self, counts: dict[tuple[int, int], int] | None = None):
        edges = np.zeros(9 * len(KINDS))
        nodes = [np.zeros(3 * values) for values in FEATURES.values()]
        for (table, code), n in (counts or {}).items():
            (edges if table == 0 else nodes[table - 1])[code] = n
        prior = _prior_edges()
        edge = np.where(prior > 0, edges.reshape(len(KINDS), 3, 3) + prior, 0)
        with np.errstate(divide="ignore"):  # every row has a state that can be
            self.edge = np.log(edge / edge.sum(axis=2, keepdims=True))
        self.node = []
        for name, table in zip(FEATURES, nodes, strict=True):
            table = table.reshape(-1, 3) + 0.5
            cut = {"size": _SIZES, "linked": _SHARES, "form": _SIZES}[name]
            for own in (table[:cut], table[cut:]):  # elements, texts
                own /= own.sum(axis=0)
            doubt = table.mean(axis=1, keepdims=True)
            self.node.append(np.log((1 - _DOUBT) * table + _DOUBT * doubt))

    def marginals(self, trees: Trees) -> np.ndarray:
        """The probability of every node to be content."""
        up = np.zeros((len(trees.kind), 3))
        for table, values in zip(self.node, trees.features(trees.kind), strict=True):
            up += table[values]
        sent = np.zeros_like(up)
        for nodes in reversed(trees.levels):
            pair = self.edge[trees.kind[nodes]] + up[nodes][:, None, :]
            sent[nodes] = np.logaddexp.reduce(pair, axis=2)
            np.add.at(up, trees.parent[nodes], sent[nodes])
        belief = np.full_like(up, -np.inf)
        belief[trees.forest.roots, NEUTRAL] = 0
        for nodes in trees.levels:
            above = belief[trees.parent[nodes]] - sent[nodes]
            pair = self.edge[trees.kind[nodes]] + above[:, :, None]
            own = up[nodes] + np.logaddexp.reduce(pair, axis=1)
            belief[nodes] = own - np.logaddexp.reduce(own, axis=1)[:, None]
        return np.exp(belief[:, CONTENT])


def _taught(trees: Trees) -> Iterator[tuple[int, np.ndarray]]:
    """(table, codes) of the labelled pages, plain and in disguise.

    In disguise the page itself is an element like others, inside a neutral one.
    """
    state, taught = trees.labels()
    above = np.where(trees.kind == ROOT, NEUTRAL, state[np.maximum(trees.parent, 0)])
    plain = taught & (trees.kind != ROOT)
    hidden = np.where((trees.kind < NAMED) | (trees.kind == ROOT), OTHER, trees.kind)
    for kind, some in ((trees.kind, plain), (hidden, taught)):
        yield 0, 9 * kind[some] + 3 * above[some] + state[some]
        for i, values in enumerate(trees.features(kind)):
            yield i + 1, 3 * values[some] + state[some]


def train(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` of the pages that mark their article, drawn by their ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for table, codes in _taught(Trees(batch.column("html").to_pylist())):
                for code, n in zip(*np.unique(codes, return_counts=True), strict=True):
                    at = table, int(code)
                    totals[at] = totals.get(at, 0) + int(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t for t, _ in totals], pa.int32()),
                pa.array([c for _, c in totals], pa.int32()),
                pa.array(list(totals.values()), pa.int64()),
            ],
            names=["t", "code", "n"],
        )

    marked = pages.filter(F.lower(html).rlike("<article[\\s>]"))
    share = sample / max(marked.count(), 1)
    rows = (
        marked.filter(hash_unit(SEED, F.col(key)) < share)
        .select(F.col(html).alias("html"))
        .mapInArrow(count, "t int, code int, n long")
        .groupBy("t", "code")
        .agg(F.sum("n").alias("n"))
        .collect()  # no more rows than the model has numbers
    )
    return Model({(r.t, r.code): r.n for r in rows})


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main texts of some pages."""
    trees = Trees(pages)
    kept = model.marginals(trees)[trees.text_node] >= 0.5
    pieces: list[list[tuple[bool, str]]] = [[] for _ in pages]
    page = np.searchsorted(trees.forest.roots, trees.text_node, side="right") - 1
    skipped = False
    for i, at in enumerate(page):
        begins = trees.forest.begins[i]
        if kept[i]:
            pieces[at].append((begins or skipped, trees.forest.text[i]))
            skipped = False
        else:
            skipped = begins or skipped
    return [page_text(p) for p in pieces]


# Pages whose trees are held at once.
_PAGES = 500


def main_text(html: Column, model: Model) -> Column:
    """The main text as a column; '' for NULL."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_pylist()
            out: list[str] = []
            for i in range(0, len(rows), _PAGES):
                out += extract(rows[i : i + _PAGES], model)
            yield pa.array(out, pa.string())

    return texts(html)


def pages_digest(pages: DataFrame) -> DataFrame:
    """Every page with its main text."""
    model = train(pages)
    found = pages.select("page_id", "url", main_text(F.col("html"), model).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
