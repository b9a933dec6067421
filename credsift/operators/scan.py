"""Secret scans over text tables.

Input: repository, file_path, commit_hash, text. Whole texts are tested first, and only texts
that can hold a finding are split into lines, so a scan neither shuffles nor multiplies rows
without hits. Each style reports under its own name in ``found_by``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.functions.entropy import shannon_entropy
from credsift.functions.keys import finding_id
from credsift.functions.text import strip_space
from credsift.schema import FINDING_COLUMNS
from credsift.session import cut
from credsift.sources.variants import once

# The styles of scanning, in the order in which their findings arrive.
STYLES = ["rules", "entropy", "keywords", "context"]

_HITS_DDL = "array<struct<style: string, rule: string, value: string, pos: int>>"

LINE_BREAK = r"\r\n|\r|\n"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group holding the value, and texts of which any match contains one.

    A rule with a ``block_end`` takes the block from the match to the next end, over as many
    lines as it has, and the match in the line alone only where no end follows.
    """

    name: str
    pattern: str
    group: int = 0
    literals: tuple[str, ...] = ()
    any_case: bool = False
    gate_pattern: str | None = None
    block_end: str | None = None

    def gate(self, text: Column) -> Column:
        """Cheap test that no text with a match fails; searching a text beats a pattern."""
        if not self.literals:
            return text.rlike(self.gate_pattern or self.pattern)
        folded = F.lower(text) if self.any_case else text
        # the one-element array makes sure that the text is folded only once
        return F.exists(
            F.array(folded),
            lambda t: reduce(or_, (F.contains(t, F.lit(word)) for word in self.literals)),
        )


_WORDS = "token|secret|password|passwd|api_?key|private_?key"
_LITERALS = ("token", "secret", "passw", "api_key", "apikey", "private_key", "privatekey")
_BLANK = r"[ \t]*"

RULES = [
    Rule("aws-access-token", r"AKIA[0-9A-Z]{16}", literals=("AKIA",)),
    Rule("github-token", r"ghp_[0-9A-Za-z]{16,}", literals=("ghp_",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", literals=("eyJ",)),
    Rule(
        "private-key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        literals=("-----BEGIN ",),
        block_end=r"-----END [A-Z ]*PRIVATE KEY-----",
    ),
    Rule(
        "url-credentials",
        r"[a-z][a-z0-9+.-]*://[^ \t:/@]+:[^ \t/@]+@[^ \t\"'<>]+",
        literals=("://",),
    ),
    Rule(
        "assigned-secret",
        rf"(?i)(?:{_WORDS}){_BLANK}(?:=>|=|:){_BLANK}[\"']([^\"']{{8,}})[\"']",
        1,
        _LITERALS,
        any_case=True,
    ),
    Rule("hex-token", r"\b[0-9a-f]{40}\b"),
]
CONTEXT = Rule(
    "assignment",
    rf"(?i)[a-z0-9_.$-]*(?:{_WORDS})[a-z0-9_]*{_BLANK}(?:=>|=|:){_BLANK}[\"'][^\"']{{8,}}[\"']",
    literals=_LITERALS,
    any_case=True,
)
KEYWORD = Rule(
    "keyword-line",
    rf"(?i)(?:{_WORDS})[\"']?{_BLANK}(?:=|:)",
    literals=_LITERALS,
    any_case=True,
)
CANDIDATE = Rule(
    "high-entropy",
    r"[A-Za-z0-9+/=_-]{20,}",
    # starting only where a token starts saves looking at every suffix of every word
    gate_pattern=r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20}",
)

# Bits per character from which a candidate counts: hexadecimal texts, all others.
HEX_BITS, OTHER_BITS = 3.0, 4.5


def text_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines of each text; the other columns are kept."""
    rest = [c for c in texts.columns if c != "text"]
    return texts.select(
        *rest, F.posexplode(F.split("text", LINE_BREAK)).alias("line_pos", "line")
    ).select(*rest, (F.col("line_pos") + 1).alias("line_number"), "line")


_BLOCK_DDL = "array<struct<line_pos: int, line: string, rule: string, block: string, pos: int>>"


def _begins(rule: Rule, text: Column) -> Column:
    return reduce(or_, (F.contains(text, F.lit(word)) for word in rule.literals))


def _until_last_end(rule: Rule, lines: Column) -> Column:
    """The text up to the last end of a block, with line feeds as line breaks."""
    text = F.regexp_extract(F.array_join(lines, "\n"), rf"^[\s\S]*{rule.block_end}", 0)
    return F.when(_begins(rule, F.col("text")), text)


def _match_lines(rule: Rule, lines: Column) -> Column:
    """The line of every match, in the order of the text."""

    def per_line(line: Column, pos: Column) -> Column:
        matches = F.regexp_extract_all(line, F.lit(rule.pattern), F.lit(0))
        return F.when(_begins(rule, line), F.array_repeat(pos, F.size(matches)))

    found = F.filter(F.transform(lines, per_line), lambda x: x.isNotNull())
    return F.when(_begins(rule, F.col("text")), F.flatten(found))


def _block_rows(rule: Rule, blocks: Column, heads: Column) -> Column:
    def row(block: Column, k: Column) -> Column:
        at = F.get(heads, k)
        return F.struct(
            at.alias("line_pos"),
            F.lit(None).cast("string").alias("line"),
            F.lit(rule.name).alias("rule"),
            block.alias("block"),
            (k - F.array_position(heads, at) + 1).cast("int").alias("pos"),
        )

    return F.coalesce(F.transform(blocks, row), F.array().cast(_BLOCK_DDL))


def _scanned_lines(texts: DataFrame) -> DataFrame:
    """Numbered lines, and the blocks that begin in them as rows of their own (no ``line``).

    Blocks are found in one pass over the text up to the last end, as every match before that has
    an end; the k-th match is the k-th block, which gives its line. Line breaks inside blocks are
    line feeds. ``closed`` holds per rule the last line with a block. Only texts with a rule's
    first literal are looked at.
    """
    rest = [c for c in texts.columns if c != "text"]
    lines = F.col("_lines")
    numbered = once(texts, _lines=F.split("text", LINE_BREAK))
    closed, blocks = {}, []
    for n, rule in enumerate(r for r in RULES if r.block_end):
        numbered = once(numbered, **{f"_until{n}": _until_last_end(rule, lines)})
        numbered = once(
            numbered,
            **{
                f"_blocks{n}": F.regexp_extract_all(
                    F.col(f"_until{n}"),
                    F.lit(rf"(?=({rule.pattern}[\s\S]*?{rule.block_end}))"),
                    F.lit(1),
                ),
                f"_heads{n}": _match_lines(rule, lines),
            },
        )
        own, heads = F.col(f"_blocks{n}"), F.col(f"_heads{n}")
        closed[rule.name] = F.coalesce(F.get(heads, F.size(own) - 1), F.lit(-1))
        blocks.append(_block_rows(rule, own, heads))
    plain = F.transform(
        lines,
        lambda line, pos: F.struct(
            pos.alias("line_pos"),
            line.alias("line"),
            F.lit(None).cast("string").alias("rule"),
            F.lit(None).cast("string").alias("block"),
            F.lit(None).cast("int").alias("pos"),
        ),
    )
    return numbered.select(
        *rest,
        F.struct(*(c.alias(name) for name, c in closed.items())).alias("closed"),
        F.explode(F.concat(plain, *blocks)).alias("l"),
    ).select(
        *rest,
        (F.col("l.line_pos") + 1).alias("line_number"),
        F.coalesce("l.line", F.lit("")).alias("line"),
        F.struct("l.rule", "l.block", "l.pos").alias("block"),
        "closed",
    )


def _candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Texts in which at least one rule may match. Rules with equal gates share one test."""
    gates = {}
    for rule in sorted(rules, key=lambda r: not r.literals):
        gates.setdefault(rule.literals or rule.pattern, rule.gate(F.col("text")))
    return texts.filter(reduce(or_, gates.values()))


def _hits(style: str, rule: Rule, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches of a rule in the line."""
    found = F.regexp_extract_all(F.col("line"), F.lit(rule.pattern), F.lit(rule.group))
    if keep is not None:
        found = F.filter(found, keep)

    def hit(value: Column, pos: Column) -> Column:
        return F.struct(
            F.lit(style).alias("style"),
            F.lit(rule.name).alias("rule"),
            value.alias("value"),
            pos.alias("pos"),
        )

    hits = F.transform(found, hit)
    if not rule.literals:
        return hits
    gate = rule.gate(F.col("line"))
    if rule.block_end:
        gate = gate & (F.col("line_number") - 1 > F.col("closed")[rule.name])
    hits = F.when(gate, hits)
    if rule.block_end:
        block = F.col("block")
        hits = F.when(block["rule"] == rule.name, F.array(hit(block["block"], block["pos"]))).otherwise(
            hits
        )
    return F.coalesce(hits, F.array().cast(_HITS_DDL))


def _line_hit(style: str, rule: Rule) -> Column:
    """The whole line when the rule matches in it."""
    hit = F.struct(
        F.lit(style).alias("style"),
        F.lit(rule.name).alias("rule"),
        strip_space(F.col("line")).alias("value"),
        F.lit(0).alias("pos"),
    )
    matched = F.col("line").rlike(rule.pattern)
    return F.filter(F.array(hit), lambda _: matched)


def _findings(lines: DataFrame, *hits: Column) -> DataFrame:
    """Hits in each line (context columns, line_number, line) as findings, in style order."""
    style = F.col("hit.style")
    rank = F.array_position(F.array(*map(F.lit, STYLES)), style) - 1
    seq = F.struct(
        rank.cast("int").alias("tool"),
        F.col("file_path").alias("path"),
        F.col("line_number").cast("bigint").alias("block"),
        F.col("hit.rule").alias("key"),
        F.col("hit.pos").cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("sub"),
    )
    exploded = lines.select("*", F.explode(F.concat(*hits)).alias("hit"))
    return exploded.select(
        finding_id(F.col("repository"), F.col("file_path"), F.col("hit.value")).alias("id"),
        "repository",
        "file_path",
        F.col("line_number").cast("int").alias("line_number"),
        F.col("hit.rule").alias("secret_type"),
        F.col("hit.value").alias("secret_value"),
        "commit_hash",
        F.array(style).alias("found_by"),
        seq.alias("seq"),
    )


def looks_random(token: Column) -> Column:
    bits = shannon_entropy(token)
    is_hex = token.rlike("^[0-9a-fA-F]+$")
    return F.when(is_hex, bits >= HEX_BITS).otherwise(bits >= OTHER_BITS)


def _by_rules() -> list[Column]:
    return [_hits("rules", rule) for rule in RULES]


def _by_entropy() -> list[Column]:
    return [_hits("entropy", CANDIDATE, looks_random)]


def scan_rules(texts: DataFrame) -> DataFrame:
    """The value alone, by rule."""
    return _findings(_scanned_lines(_candidates(texts, RULES)), *_by_rules())


def scan_entropy(texts: DataFrame) -> DataFrame:
    """Long tokens that look random."""
    return _findings(_scanned_lines(_candidates(texts, [CANDIDATE])), *_by_entropy())


def scan_keyword_lines(texts: DataFrame) -> DataFrame:
    """The whole line around a keyword."""
    lines = _scanned_lines(_candidates(texts, [KEYWORD]))
    return _findings(lines, _line_hit("keywords", KEYWORD))


def scan_with_context(texts: DataFrame) -> DataFrame:
    """The value together with the assignment around it."""
    return _findings(_scanned_lines(_candidates(texts, [CONTEXT])), _hits("context", CONTEXT))


def scan_all(texts: DataFrame) -> DataFrame:
    """All styles in one pass over the texts."""
    lines = _scanned_lines(_candidates(texts, [CANDIDATE, KEYWORD, CONTEXT, *RULES]))
    return _findings(
        lines,
        *_by_rules(),
        *_by_entropy(),
        _line_hit("keywords", KEYWORD),
        _hits("context", CONTEXT),
    )


def scan_history(versions: DataFrame) -> DataFrame:
    """Scan file versions by rule, each distinct content once.

    Input: repository, file_path, commit_hash, commit_ts, text. Versions without any candidate
    are dropped before contents are compared. The commit reported is the earliest one holding
    the content at that path.
    """
    # written once: both branches below read it, and only texts that can match are in it
    candidates = cut(
        _candidates(versions, RULES).withColumn("blob_id", F.sha2("text", 256)), "scan-candidates"
    )
    # equal contents have equal texts, so any of them serves
    contents = candidates.select("blob_id", "text").dropDuplicates(["blob_id"])
    occurrences = (
        candidates.groupBy("repository", "file_path", "blob_id")
        .agg(F.min(F.struct("commit_ts", "commit_hash")).alias("first"))
        .select(
            "repository", "file_path", "blob_id", F.col("first.commit_hash").alias("commit_hash")
        )
    )
    # only lines with a hit meet their occurrences
    any_hit = reduce(or_, (F.col("line").rlike(rule.pattern) for rule in RULES))
    any_hit = any_hit | F.col("block.rule").isNotNull()
    lines = _scanned_lines(contents).filter(any_hit).join(occurrences, "blob_id")
    return _findings(lines, *_by_rules())
