"""Readers by tool name. New tools register a function from landing rows to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsift.schema import FINDING_COLUMNS
from credsift.session import cut
from credsift.sources import detect_secrets, gitleaks, landing, titus, trufflehog

Reader = Callable[..., DataFrame]

_readers: dict[str, Reader] = {}
_rejects: dict[str, Reader] = {}
# tools whose reports are parsed into parts first, from which both findings and rejects come
_parsed: dict[str, ModuleType] = {}


def register(
    tool: str,
    reader: Reader,
    rejects: Reader | None = None,
    raw_name: str | None = None,
    by_line: bool = False,
) -> None:
    """Add a tool, or replace one.

    ``reader`` turns landing rows into findings with ``seq`` (see ``schema.arrival``).
    ``raw_name`` is what the names of its raw reports end in; with it, the drop area, the stream
    and the arrival order know the tool, too. ``by_line``: reports have one record per line.
    """
    _parsed.pop(tool, None)
    _readers[tool] = reader
    if rejects is not None:
        _rejects[tool] = rejects
    if raw_name is not None:
        landing.add_tool(tool, raw_name, by_line)


def unregister(tool: str) -> None:
    _readers.pop(tool, None)
    _rejects.pop(tool, None)
    _parsed.pop(tool, None)
    landing.drop_tool(tool)


for _tool in (gitleaks, trufflehog, detect_secrets, titus):
    register(_tool.TOOL, _tool.findings, _tool.rejects)
    _parsed[_tool.TOOL] = _tool


def known_tools() -> list[str]:
    return list(_readers)


def read_findings(reports: DataFrame, tools: Iterable[str] | None = None, **lookups) -> DataFrame:
    """Findings of all chosen tools as one bag; unknown tools are ignored.

    ``blob_id`` is the blob a finding was made in, for attribution; '' where a tool names none.

    ``lookups`` maps a tool name with ``_`` for ``-`` to keyword arguments of its reader, for
    example ``titus={"blob_paths": paths}``.
    """
    return _union(
        [(t, _readers[t](reports, **_lookups(t, lookups))) for t in _chosen(tools)], reports
    )


def read_reports(
    reports: DataFrame, tools: Iterable[str] | None = None, **lookups
) -> tuple[DataFrame, DataFrame]:
    """Findings and rejects of one reading: the parsed parts of every tool are written once.

    Rejects have (repository, tool, raw, reason, path, at).
    """
    found, bad = [], []
    for tool in _chosen(tools):
        own = _lookups(tool, lookups)
        if tool in _parsed:
            parts = cut(_parsed[tool].parts(reports), f"parts-{tool}")
            found.append((tool, _parsed[tool].findings_of(parts, **own)))
            bad.append(_parsed[tool].rejects_of(parts))
        else:
            found.append((tool, _readers[tool](reports, **own)))
            if tool in _rejects:
                bad.append(_rejects[tool](reports))
    return _union(found, reports), _all_rejects(bad, reports)


def resolve(found: DataFrame, **lookups) -> DataFrame:
    """Findings that were read without ``lookups`` as if they had been read with them.

    ``found`` holds findings before any merge, with ``blob_id``.
    """
    rest, parts = found, []
    for tool, module in _parsed.items():
        own = _lookups(tool, lookups)
        if own:
            is_own = F.col("found_by")[0] == tool
            parts.append(module.resolve(found.filter(is_own), **own))
            rest = rest.filter(~is_own)
    for part in parts:
        rest = rest.unionByName(part)
    return rest


def read_rejects(reports: DataFrame) -> DataFrame:
    """Reports and records that could not be used, with the reason."""
    return _all_rejects([reader(reports) for reader in _rejects.values()], reports)


def _chosen(tools: Iterable[str] | None) -> list[str]:
    return [t for t in (known_tools() if tools is None else tools) if t in _readers]


def _lookups(tool: str, lookups: dict) -> dict:
    return lookups.get(tool.replace("-", "_"), {})


def _union(found: list[tuple[str, DataFrame]], reports: DataFrame) -> DataFrame:
    union: DataFrame | None = None
    for tool, part in found:
        missing = [c for c in [*FINDING_COLUMNS, "seq"] if c not in part.columns]
        if missing:
            raise ValueError(f"reader of {tool} lacks {missing}")
        if "blob_id" not in part.columns:
            part = part.withColumn("blob_id", F.lit(""))
        part = part.select(*FINDING_COLUMNS, "seq", "blob_id")
        union = part if union is None else union.unionByName(part)
    return read_findings(reports, [gitleaks.TOOL]).filter(F.lit(False)) if union is None else union


def _all_rejects(parts: list[DataFrame], reports: DataFrame) -> DataFrame:
    union = gitleaks.rejects(reports).filter(F.lit(False))
    for part in parts:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
