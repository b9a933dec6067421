"""The drop area of raw reports and its landing table.

A drop area holds one folder per repository with reports named
``<repository>_<tool>_raw.json``. The landing table keeps every report unchanged:

    repository, tool, path, block, pos, value

Line-delimited reports have one row per line, with ``block`` and ``pos`` in line order. Whole-document
tools have one row per report (``pos`` 0) up to ``WHOLE_BYTES``. A larger report is read by as many
tasks as other large files are: it has one row per chunk of about ``CHUNK_BYTES`` that ends behind a
``}`` (``pos`` from 1 on), and from each task a row without text whose ``block`` is the length of the
file, as the last task may find no piece that begins in its part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.functions.text import last_path_part
from credsift.schema import TOOLS

LANDING_DDL = (
    "repository STRING, tool STRING, path STRING, block BIGINT, pos BIGINT, value STRING"
)

# The raw report name of each tool, after the repository prefix.
RAW_NAMES = {
    "gitleaks": "gitleaks_raw.json",
    "trufflehog": "trufflehog_raw.json",
    "detect-secrets": "detect_secrets_raw.json",
    "titus": "titus_raw.json",
}
LINE_DELIMITED = {"trufflehog"}

WHOLE_BYTES = 16 << 20
CHUNK_BYTES = 8 << 20


def add_tool(tool: str, raw_name: str, by_line: bool) -> None:
    """Make the raw reports of a further tool known; it arrives after the others."""
    RAW_NAMES[tool] = raw_name
    (LINE_DELIMITED.add if by_line else LINE_DELIMITED.discard)(tool)
    if tool not in TOOLS:
        TOOLS.append(tool)


def drop_tool(tool: str) -> None:
    RAW_NAMES.pop(tool, None)
    LINE_DELIMITED.discard(tool)
    if tool in TOOLS:
        TOOLS.remove(tool)


def read_landing(
    spark: SparkSession,
    root: str,
    tools: Iterable[str] | None = None,
    levels: int = 1,
    pattern: str | None = None,
) -> DataFrame:
    """Reports below ``root`` for the chosen tools (all if None); unknown names are ignored.

    Only files of chosen tools are listed. A missing folder or report yields no rows. A
    repository is named by its last ``levels`` folders, so that ``org1/api`` and ``org2/api``
    can be told apart. ``pattern`` stands in for the tool's own file name (a glob).
    """
    landing = spark.createDataFrame([], LANDING_DDL)
    for tool in dict.fromkeys(TOOLS if tools is None else tools):
        if tool in RAW_NAMES:
            landing = landing.unionByName(_read_tool(spark, root, tool, levels, pattern))
    return landing


def _read_tool(
    spark: SparkSession, root: str, tool: str, levels: int, pattern: str | None
) -> DataFrame:
    try:
        return read_files(
            spark, [root], tool, levels, pathGlobFilter=pattern or f"*{RAW_NAMES[tool]}"
        )
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LANDING_DDL)


def read_files(
    spark: SparkSession, paths: list[str], tool: str, levels: int = 1, **options: str
) -> DataFrame:
    """Landing rows of the reports of one tool that are, or lie below, ``paths``."""
    reader = (
        spark.read.options(**options)
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
    )
    if tool in LINE_DELIMITED:
        return landing_rows(reader.text(paths), tool, levels)
    # files that the filters leave out are not opened
    large = F.col("_metadata.file_size") > WHOLE_BYTES
    whole = reader.text(paths, wholetext=True).filter(~large)
    chunks = _chunks(reader.text(paths, lineSep="}").filter(large), tool, levels)
    return landing_rows(whole, tool, levels).unionByName(chunks)


def listed_names(files: DataFrame) -> list[str]:
    """The paths of a bounded number of listed files, as a reader takes them."""
    # a name that holds signs of patterns stands for itself
    return [
        re.sub(r"([\\{}\[\]*?])", r"\\\1", row.path) for row in files.select("path").collect()
    ]


def _chunks(pieces: DataFrame, tool: str, levels: int) -> DataFrame:
    """Rows of about ``CHUNK_BYTES`` from the texts between the ``}`` of large reports.

    A split is read by one task from start to end, so its pieces are joined as they come.
    """
    size = CHUNK_BYTES

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block", "pos", "octets"]

        def row(path: str, block: int, pos: int, value: bytes) -> pa.RecordBatch:
            columns = [pa.array([path]), pa.array([block], pa.int64()),
                       pa.array([pos], pa.int64()), pa.array([value], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        split: tuple | None = None  # path, start, length of the file
        held: list[bytes] = []
        held_size = pos = 0

        def rest() -> Iterator[pa.RecordBatch]:
            if split is not None:
                path, start, length = split
                if held:
                    yield row(path, start, pos + 1, b"}".join(held) + b"}")
                yield row(path, length, start + 1, b"")

        for batch in batches:

            def place(i: int, batch: pa.RecordBatch = batch) -> tuple:
                return tuple(batch.column(c)[i].as_py() for c in ("path", "start", "length"))

            octets, begin, rows = batch.column("octets"), 0, batch.num_rows
            while begin < rows:
                own, end = place(begin), rows
                if place(rows - 1) != own:  # a split's pieces lie together
                    end = bisect_left(range(rows), True, begin, key=lambda i: place(i) != own)
                if own != split:
                    yield from rest()
                    split, held, held_size, pos = own, [], 0, 0
                values = octets.slice(begin, end - begin).to_pylist()
                begin, first = end, 0
                sizes = np.cumsum([len(v) + 1 for v in values])
                while first < len(values):
                    done = int(sizes[first - 1]) if first else 0
                    last = int(np.searchsorted(sizes, done + size - held_size))
                    held += values[first : last + 1]
                    first = last + 1
                    if last == len(values):
                        held_size += int(sizes[-1]) - done
                        break
                    pos += 1
                    yield row(own[0], own[1], pos, b"}".join(held) + b"}")
                    held, held_size = [], 0
        yield from rest()

    joined = pieces.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("length"),
        F.col("value").cast("binary").alias("octets"),
    ).mapInArrow(join, "path STRING, block BIGINT, pos BIGINT, octets BINARY")
    # once a chunk, not once a piece
    return joined.withColumn("path", _decoded(F.col("path"))).select(
        repository_of(F.col("path"), levels).alias("repository"),
        F.lit(tool).alias("tool"),
        "path",
        "block",
        "pos",
        F.col("octets").cast("string").alias("value"),
    )


def landing_rows(files: DataFrame, tool: str, levels: int = 1) -> DataFrame:
    """Landing rows of text files that were just read, in a batch or a stream."""
    path = _decoded(F.col("_metadata.file_path"))
    by_line = tool in LINE_DELIMITED
    # a split is read by one task from start to end, so (split, row in task) is line order
    return files.select(
        repository_of(path, levels).alias("repository"),
        F.lit(tool).alias("tool"),
        path.alias("path"),
        (F.col("_metadata.file_block_start") if by_line else F.lit(0)).cast("bigint")
        .alias("block"),
        (F.monotonically_increasing_id() if by_line else F.lit(0)).cast("bigint").alias("pos"),
        "value",
    )


def repository_of(path: Column, levels: int = 1) -> Column:
    """The folders that hold the report, plain or written as ``repository=<name>``."""
    # cut at slashes, as it is done for every line; a pattern would be tried from every character
    end = F.substring_index(path, "/", -levels - 1)
    name = F.substring_index(path, "/", -1)
    folders = F.left(end, F.length(end) - F.length(name) - F.lit(1))
    return F.regexp_replace(folders, "(^|/)repository=", "$1")


def _decoded(uri: Column) -> Column:
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(uri, F.lit("%")), decoded).otherwise(uri)


def select_tools(landing: DataFrame, tools: Iterable[str]) -> DataFrame:
    """Keep reports of the chosen, known tools; prunes partitions of a landing table."""
    return landing.filter(F.col("tool").isin([t for t in tools if t in RAW_NAMES]))


def write_landing(landing: DataFrame, path: str) -> None:
    # reports repeat their names, which zstd makes far smaller than the default does
    landing.write.option("compression", "zstd").partitionBy("tool").mode("overwrite").parquet(path)


def open_landing(spark: SparkSession, path: str) -> DataFrame:
    columns = [c.split(" ")[0] for c in LANDING_DDL.split(", ")]
    return spark.read.schema(LANDING_DDL).parquet(path).select(*columns)


def repositories(paths: DataFrame) -> DataFrame:
    """Repositories seen in a set of report or repository paths (column ``path``)."""
    return paths.select(last_path_part(F.col("path")).alias("repository")).distinct()


def _listed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, length) of files, from their listing alone; no file is opened."""
    files = spark.read.format("binaryFile").options(**options)
    try:
        return files.load(path).select(_decoded(F.col("path")).alias("path"), "length")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path STRING, length BIGINT")


def list_reports(
    spark: SparkSession,
    root: str,
    tools: Iterable[str] | None = None,
    levels: int = 1,
    pattern: str | None = None,
) -> DataFrame:
    """(repository, tool, path, length) of the reports below ``root``, as ``read_landing`` reads
    them, without reading any."""
    reports = spark.createDataFrame([], "repository STRING, tool STRING, path STRING, length BIGINT")
    for tool in dict.fromkeys(TOOLS if tools is None else tools):
        if tool in RAW_NAMES:
            options = {"pathGlobFilter": pattern or f"*{RAW_NAMES[tool]}", "recursiveFileLookup": "true"}
            reports = reports.unionByName(
                _listed(spark, root, **options).select(
                    repository_of(F.col("path"), levels).alias("repository"),
                    F.lit(tool).alias("tool"),
                    "path",
                    "length",
                )
            )
    return reports


def discover_repositories(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """(repository, path) of the working copies at or below ``root``.

    ``root`` itself if it holds ``.git``, else the folders ``levels`` below it that do, else
    ``root`` as the one target. Only the names of ``.git/HEAD`` files are looked at.
    """
    root = root.rstrip("/")
    own = _copies(_listed(spark, f"{root}/.git/HEAD"), 1)
    if not own.isEmpty():
        return own
    below = _copies(_listed(spark, f"{root}{'/*' * levels}/.git/HEAD"), levels)
    if not below.isEmpty():
        return below
    whole = spark.createDataFrame([(root,)], "path STRING")
    return whole.select(last_path_part(F.col("path")).alias("repository"), "path")


def _copies(heads: DataFrame, levels: int) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("path", "/[.]git/HEAD$", ""), "^file:/+", "/")
    return heads.select(repository_of(F.concat(path, F.lit("/.git")), levels).alias("repository"),
                        path.alias("path"))
