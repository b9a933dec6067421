"""Every registered query: a callable from (session, table folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.functions import text as T
from credsift.functions.codec import base64_text
from credsift.functions.entropy import shannon_entropy
from credsift.functions.keys import finding_id, has_location, secret_key
from credsift.operators import attribution, dedup, reports, scan
from credsift.operators.merge import merge_by, union_of_tools, with_norm
from credsift.operators.proximity import absorb_overlapping
from credsift.plans import inputs
from credsift.schema import FINDING_COLUMNS, arrival
from credsift.session import cut, fresh_path, tune, workspace
from credsift.sources import blobs, detect_secrets, landing, registry, titus, trufflehog
from credsift.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, a trailing underscore dropped."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


def flat(findings: DataFrame) -> DataFrame:
    """Finding columns with the tools as one text."""
    return findings.select(*FINDING_COLUMNS).withColumn(
        "found_by", F.array_join("found_by", ",")
    )


# readers


@query
def gitleaks_report(spark, sf_dir):
    return flat(registry.read_findings(inputs.gitleaks_reports(spark, sf_dir), ["gitleaks"]))


@query
def trufflehog_report(spark, sf_dir):
    return flat(registry.read_findings(inputs.trufflehog_reports(spark, sf_dir), ["trufflehog"]))


@query
def trufflehog_raw_or_redacted(spark, sf_dir):
    found = trufflehog.findings(inputs.trufflehog_reports(spark, sf_dir))
    return (
        found.withColumn("redacted", F.endswith("secret_value", F.lit("***")))
        .groupBy("repository", "redacted")
        .agg(F.count("*").alias("findings"), F.min("secret_value").alias("smallest"))
    )


@query
def detect_secrets_report(spark, sf_dir):
    return flat(detect_secrets.findings(inputs.detect_secrets_reports(spark, sf_dir)))


@query
def detect_secrets_line_lookup(spark, sf_dir):
    return flat(
        detect_secrets.findings(
            inputs.detect_secrets_reports(spark, sf_dir), inputs.source_lines(spark, sf_dir)
        )
    )


@query
def titus_report(spark, sf_dir):
    return flat(titus.findings(inputs.titus_reports(spark, sf_dir)))


@query
def titus_groups_fallback(spark, sf_dir):
    return flat(titus.group_findings(inputs.titus_reports(spark, sf_dir)))


@query
def titus_blob_join(spark, sf_dir):
    paths = blobs.blob_paths(inputs.provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir))
    return flat(titus.findings(inputs.titus_reports(spark, sf_dir), paths))


@query
def b64_decode(spark, sf_dir):
    rows = inputs.encoded_values(spark, sf_dir)
    return rows.select("ok", "ln", "encoded", base64_text(F.col("encoded")).alias("decoded"))


@query
def blob_path_first(spark, sf_dir):
    return blobs.paths_from_provenance(inputs.provenance(spark, sf_dir))


@query
def blob_path_ffill(spark, sf_dir):
    return blobs.paths_from_text(inputs.report_lines(spark, sf_dir), chunk=1000)


@query
def blob_path_fallback(spark, sf_dir):
    return blobs.blob_paths(
        inputs.provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir)
    )


@query
def repositories(spark, sf_dir):
    return landing.repositories(
        inputs.all_reports(spark, sf_dir).select(
            F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("path")
        )
    )


def _drop_area(spark, sf_dir, tools) -> str:
    """A drop area with one report per repository and tool, all records of a repository in it."""
    drop = fresh_path(spark, "estate-drop")
    for tool in tools:
        inputs.repository_report_lines(spark, sf_dir, tool).write.partitionBy("repository").text(
            f"{drop}/{tool}"
        )
    return drop


@query
def repository_reports(spark, sf_dir):
    """Reports of many records, read from files: gitleaks and titus, with files of blobs."""
    drop = _drop_area(spark, sf_dir, ["gitleaks", "titus"])
    paths = blobs.blob_paths(inputs.provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir))
    raw = [
        landing.read_landing(spark, f"{drop}/{tool}", [tool], pattern="*.txt")
        for tool in ("gitleaks", "titus")
    ]
    return flat(
        registry.read_findings(
            raw[0].unionByName(raw[1]), ["gitleaks", "titus"], titus={"blob_paths": paths}
        )
    )


@query
def listed_repositories(spark, sf_dir):
    """Repositories of a drop area, from the names of its files alone."""
    drop = _drop_area(spark, sf_dir, ["gitleaks"])
    return (
        landing.list_reports(spark, drop, ["gitleaks"], pattern="*.txt")
        .groupBy("repository", "tool")
        .agg(F.count("*").alias("reports"))
    )


@query
def tool_selection(spark, sf_dir):
    chosen = landing.select_tools(
        inputs.all_reports(spark, sf_dir), ["titus", "gitleaks", "no-such-tool"]
    )
    return chosen.groupBy("tool", "repository").agg(F.count("*").alias("reports"))


@query
def missing_report(spark, sf_dir):
    """Findings per repository when only gitleaks left reports: the other tools add none."""
    only = inputs.gitleaks_reports(spark, sf_dir)
    per_tool = registry.read_findings(only).select("repository", F.explode("found_by").alias("t"))
    counts = [F.count(F.when(F.col("t") == t, 1)).alias(n) for t, n in (
        ("gitleaks", "gitleaks"), ("trufflehog", "trufflehog"),
        ("detect-secrets", "detect_secrets"), ("titus", "titus"))]
    return per_tool.groupBy("repository").agg(*counts)


@query
def rejects(spark, sf_dir):
    return (
        registry.read_rejects(inputs.all_reports(spark, sf_dir))
        .groupBy("repository", "tool", "reason")
        .agg(F.count("*").alias("rows"))
    )


@query
def union_all_tools(spark, sf_dir):
    return _all_findings(spark, sf_dir).groupBy(
        "repository", F.array_join("found_by", ",").alias("tool")
    ).agg(
        F.count("*").alias("findings"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


def _all_findings(spark, sf_dir) -> DataFrame:
    return registry.read_findings(
        inputs.all_reports(spark, sf_dir),
        detect_secrets={"lines": inputs.source_lines(spark, sf_dir)},
        titus={
            "blob_paths": blobs.blob_paths(
                inputs.provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir)
            )
        },
    )


@query
def raw_landing(spark, sf_dir):
    """Reports written to the landing table and read back unchanged."""
    path = fresh_path(spark, "landing")
    landing.write_landing(inputs.all_reports(spark, sf_dir), path)
    return landing.open_landing(spark, path).select(
        "repository", "tool", F.md5("value").alias("digest"), F.length("value").alias("chars")
    )


# scalar functions and keys


@query
def normalize_secret(spark, sf_dir):
    value = F.col("secret_value")
    return inputs.awkward_values(spark, sf_dir).select(
        "secret_value", T.without_space(value).alias("normalized")
    )


@query
def normalize_dedup(spark, sf_dir):
    value = F.col("secret_value")
    return inputs.awkward_values(spark, sf_dir).select(
        "secret_value", T.normal_form(value).alias("norm")
    )


@query
def extract_core(spark, sf_dir):
    value = F.col("secret_value")
    return inputs.awkward_values(spark, sf_dir).select(
        "secret_value", T.core_form(T.normal_form(value)).alias("core")
    )


@query
def finding_id_(spark, sf_dir):
    return inputs.awkward_values(spark, sf_dir).select(
        finding_id(F.col("repository"), F.col("file_path"), F.col("secret_value")).alias("id")
    )


@query
def secret_key_(spark, sf_dir):
    return inputs.awkward_values(spark, sf_dir).select(
        secret_key(F.col("repository"), F.col("secret_value")).alias("secret_key")
    )


@query
def overlap_predicate(spark, sf_dir):
    """Every value tested against the next tool's context of the same secret and of another."""
    pairs = inputs.value_pairs(spark, sf_dir)
    a, b = T.normal_form(F.col("a")), T.normal_form(F.col("b"))
    return pairs.select(
        "a",
        "b",
        T.overlaps(T.core_form(a), b).alias("a_in_b"),
        T.overlaps(T.core_form(b), a).alias("b_in_a"),
    )


@query
def relative_path(spark, sf_dir):
    return inputs.rooted_paths(spark, sf_dir).select(
        "path",
        T.relative_path(F.col("path"), F.col("absolute_root"), F.col("given_root")).alias(
            "relative"
        ),
    )


# filters


@query
def empty_secret_filter(spark, sf_dir):
    """Empty values are kept from gitleaks and dropped from trufflehog and titus."""
    found = registry.read_findings(
        inputs.all_reports(spark, sf_dir), ["gitleaks", "trufflehog", "titus"]
    )
    return found.groupBy(F.element_at("found_by", 1).alias("tool")).agg(
        F.count(F.when(F.col("secret_value") == "", 1)).alias("empty"),
        F.count(F.when(F.col("secret_value") != "", 1)).alias("filled"),
    )


@query
def has_location_(spark, sf_dir):
    return flat(inputs.lineitem_findings(spark, sf_dir).filter(has_location()))


# attribution


@query
def blame_attribution(spark, sf_dir):
    return flat(
        attribution.attribute(
            inputs.unattributed_findings(spark, sf_dir), inputs.blame_ranges(spark, sf_dir)
        )
    )


@query
def blob_first_commit(spark, sf_dir):
    return attribution.first_commits(inputs.blob_commits(spark, sf_dir))


@query
def blame_fallback(spark, sf_dir):
    return flat(
        attribution.attribute(
            inputs.unattributed_findings(spark, sf_dir),
            inputs.blame_ranges(spark, sf_dir),
            inputs.blob_commits(spark, sf_dir),
        )
    )


# merging and deduplication


@query
def merge_best_row(spark, sf_dir):
    """Merge per repository and base value, across files and contexts."""
    found = with_norm(inputs.lineitem_findings(spark, sf_dir))
    found = found.withColumn("bare", F.regexp_extract("norm", "AKIA[0-9A-F]{16}", 0))
    return flat(merge_by(found, "repository", "bare"))


@query
def found_by_union(spark, sf_dir):
    return (
        inputs.lineitem_findings(spark, sf_dir)
        .groupBy("repository", "file_path")
        .agg(F.array_join(union_of_tools("found_by"), ",").alias("found_by"))
    )


def _pass1(spark, sf_dir) -> DataFrame:
    return dedup.merge_same_id(inputs.lineitem_findings(spark, sf_dir))


@query
def dedup_pass1(spark, sf_dir):
    return flat(_pass1(spark, sf_dir))


@query
def dedup_pass2(spark, sf_dir):
    return flat(dedup.merge_same_secret(_pass1(spark, sf_dir)))


@query
def dedup_pass3(spark, sf_dir):
    merged = cut(dedup.merge_same_secret(_pass1(spark, sf_dir)), "merged")
    return flat(absorb_overlapping(merged))


@query
def dedup_pass3_rounds(spark, sf_dir):
    """Pass 3 with every location treated as too large for one array."""
    merged = cut(dedup.merge_same_secret(_pass1(spark, sf_dir)), "merged")
    return flat(absorb_overlapping(merged, fold_rows=0))


@query
def pass3_contained(spark, sf_dir):
    """Absorption by whole values only."""
    merged = cut(dedup.merge_same_secret(_pass1(spark, sf_dir)), "merged")
    return flat(absorb_overlapping(merged, use_core=False))


@query
def dedup_findings(spark, sf_dir):
    return flat(dedup.dedup_findings(inputs.lineitem_findings(spark, sf_dir)))


@query
def dedup_many_secrets(spark, sf_dir):
    """The whole deduplication with far more distinct secrets and repositories."""
    return flat(dedup.dedup_findings(inputs.lineitem_findings(spark, sf_dir, 40000, 64)))


@query
def dedup_per_repo(spark, sf_dir):
    """Findings per repository out of the one overall run."""
    unique = dedup.dedup_findings(inputs.lineitem_findings(spark, sf_dir))
    return unique.groupBy("repository").agg(
        F.count("*").alias("findings"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.sum(F.size("found_by")).alias("tool_mentions"),
    )


@query
def reports_to_findings(spark, sf_dir):
    """Raw reports of all tools, read, looked up, attributed and deduplicated.

    Provenance names absolute paths; files that left the head are blamed at their blob's first
    revision.
    """
    paths = blobs.relative_paths(
        blobs.blob_paths(
            inputs.absolute_provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir)
        ),
        inputs.repository_roots(spark, sf_dir),
    )
    found = registry.read_findings(
        inputs.all_reports(spark, sf_dir),
        detect_secrets={"lines": inputs.source_lines(spark, sf_dir)},
        titus={"blob_paths": paths},
    )
    found = attribution.attribute(
        found, inputs.estate_blame(spark, sf_dir), inputs.estate_blob_commits(spark, sf_dir)
    )
    return flat(dedup.dedup_findings(found))


@query
def custom_tool(spark, sf_dir):
    """A fifth tool, made known by one registration, from its reports in a drop area."""

    def reader(raw: DataFrame) -> DataFrame:
        part = F.split("value", "\t")
        return raw.filter(F.col("tool") == "linescan").select(
            finding_id(F.col("repository"), part[0], part[2]).alias("id"),
            "repository",
            part[0].alias("file_path"),
            part[1].cast("int").alias("line_number"),
            F.lit("line").alias("secret_type"),
            part[2].alias("secret_value"),
            F.lit("").alias("commit_hash"),
            F.array(F.lit("linescan")).alias("found_by"),
            arrival(
                "linescan", F.col("path"), F.col("block"), F.lit(""), F.col("pos"), F.lit(0)
            ).alias("seq"),
        )

    drop = fresh_path(spark, "custom-drop")
    found = inputs.lineitem_findings(spark, sf_dir).filter("line_number IS NOT NULL")
    found.select(
        "repository",
        F.concat_ws(
            "\t", "file_path", "line_number", F.regexp_replace("secret_value", "[^A-Z0-9]", "")
        ).alias("value"),
    ).write.partitionBy("repository").text(drop)
    registry.register("linescan", reader, raw_name=".txt", by_line=True)
    try:
        reports = landing.read_landing(spark, drop, ["linescan"])
        return flat(registry.read_findings(reports, ["linescan"]))
    finally:
        registry.unregister("linescan")


# reports


def _unique(spark, sf_dir) -> DataFrame:
    return dedup.dedup_findings(inputs.lineitem_findings(spark, sf_dir))


@query
def summary_by_tool(spark, sf_dir):
    return reports.summary_by_tool(_unique(spark, sf_dir))


@query
def distinct_tools(spark, sf_dir):
    return reports.distinct_tools(_unique(spark, sf_dir))


@query
def reduction_stats(spark, sf_dir):
    return dedup.dedup_with_stats(inputs.lineitem_findings(spark, sf_dir))[1]


@query
def report_general(spark, sf_dir):
    return reports.general_report(_unique(spark, sf_dir))


@query
def report_tool_tabs(spark, sf_dir):
    return reports.tool_reports(_unique(spark, sf_dir))


@query
def report_json(spark, sf_dir):
    """JSON reports written per repository and read back as the overall report."""
    path = fresh_path(spark, "json-report")
    reports.write_json_reports(_unique(spark, sf_dir), path)
    schema = inputs.lineitem_findings(spark, sf_dir).select(*FINDING_COLUMNS).schema
    return flat(spark.read.schema(schema).json(path))


@query
def report_empty(spark, sf_dir):
    """A report of a tool selection without findings: the columns remain, rows do not."""
    none = registry.read_findings(inputs.gitleaks_reports(spark, sf_dir), ["titus"])
    return reports.general_report(dedup.dedup_findings(none))


# streaming


@query
def streaming_ingest(spark, sf_dir):
    """Trufflehog reports dropped as files, ingested batch by batch, merged by id."""
    base = fresh_path(spark, "stream")
    drop, state = f"{base}/drop", f"{base}/state"
    (
        inputs.trufflehog_reports(spark, sf_dir)
        .repartition("repository")
        .sortWithinPartitions("repository", "path")
        .select("repository", "value")
        .write.partitionBy("repository")
        .text(drop)
    )
    ingest.stream_reports(
        spark,
        "trufflehog",
        drop,
        state,
        f"{base}/checkpoint",
        pattern="part-*.txt",
        files_per_batch=3,
    ).awaitTermination()
    return flat(ingest.current_by_id(spark, state))


@query
def streaming_estate(spark, sf_dir):
    """Reports of two tools streamed into one state, files of blobs looked up afterwards."""
    base = fresh_path(spark, "stream")
    for tool in ("gitleaks", "titus"):
        # reports and what was cut out of them go once their findings are in the state
        with workspace(spark):
            drop = _drop_area(spark, sf_dir, [tool])
            ingest.stream_reports(
                spark,
                tool,
                f"{drop}/{tool}",
                f"{base}/state",
                f"{base}/checkpoint-{tool}",
                pattern="*.txt",
                files_per_batch=3,
            ).awaitTermination()
    paths = blobs.blob_paths(inputs.provenance(spark, sf_dir), inputs.report_lines(spark, sf_dir))
    return flat(ingest.current_by_id(spark, f"{base}/state", titus={"blob_paths": paths}))


# scans


@query
def text_lines(spark, sf_dir):
    return scan.text_lines(inputs.document_texts(spark, sf_dir)).select(
        "file_path", "line_number", "line"
    )


def _texts(spark, sf_dir) -> DataFrame:
    return (
        inputs.document_texts(spark, sf_dir)
        .unionByName(inputs.page_texts(spark, sf_dir))
        .unionByName(inputs.conversation_texts(spark, sf_dir))
    )


@query
def scan_rules(spark, sf_dir):
    return flat(scan.scan_rules(_texts(spark, sf_dir)))


@query
def scan_private_keys(spark, sf_dir):
    """Whole keys over several lines, several of them in one text, after deduplication."""
    found = scan.scan_rules(inputs.key_texts(spark, sf_dir))
    return flat(dedup.dedup_findings(found.filter(F.col("secret_type") == "private-key")))


@query
def scan_entropy(spark, sf_dir):
    found = scan.scan_entropy(_texts(spark, sf_dir))
    return flat(found).withColumn(
        "bits", F.round(shannon_entropy(F.col("secret_value")), 6)
    )


@query
def scan_keyword_lines(spark, sf_dir):
    return flat(scan.scan_keyword_lines(_texts(spark, sf_dir)))


@query
def scan_with_context(spark, sf_dir):
    return flat(scan.scan_with_context(_texts(spark, sf_dir)))


@query
def scan_distinct_blobs(spark, sf_dir):
    return flat(scan.scan_history(inputs.document_versions(spark, sf_dir)))


@query
def scan_and_dedup(spark, sf_dir):
    return flat(dedup.dedup_findings(scan.scan_all(_texts(spark, sf_dir))))
